import zlib

import numpy as np
import pytest

from sparkloom.llm.encode import ids
from sparkloom.llm.packing import best_plan, pack, plan, sequences
from sparkloom.llm.queries import byte_bpe
from tests.llm import edges


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    texts = [x or "" for _, x in edges.ROWS] + ["don't  stop\n\n\n now 12,345 ½ — «é»", "<|endoftext|>", "​﻿ \r\n", "a" * 3000]
    for text in texts:
        assert ids(byte_bpe(), text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_runs_of_whitespace():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    run = 800_000
    for text in (" " * run + "a b", "x" + " \n" * (run // 2), "\n" * run + "<|endoftext|>" + "\u3000" * 2000 + "b", "a" + "\t" * run + "<|endoftext" + " " * 5000):
        assert ids(byte_bpe(), text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(ids(byte_bpe(), " " * 10_000_000 + "a")) == 10_000_000
    assert len(ids(byte_bpe(), "x" * 10_000_000)) > 0


def fewest(lengths, room):
    """The least number of sequences, by trying every place for each length, longest first."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for n in sorted(set(free)):
            if n >= lengths[k]:
                rest = list(free)
                rest[rest.index(n)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, [*free, room - lengths[k]])

    place(0, [])
    return best


def test_plans_against_the_optimum():
    rng = np.random.default_rng(1)
    more = 0
    for _ in range(60):
        lengths = rng.integers(1, 33, rng.integers(1, 13)).tolist()
        got, least = sequences(best_plan(np.bincount(lengths, minlength=33), 32, 8)), fewest(lengths, 32)
        assert least <= got <= least + 1
        more += got - least
    assert more <= 6


@pytest.mark.parametrize("small", [8, 16, 32, 63])
def test_plans_place_every_length_once(small):
    rng = np.random.default_rng(small)
    for trial in range(20):
        h = np.zeros(65, int)
        for length in rng.integers(1, 65, rng.integers(1, 400)) if trial else []:
            h[length] += 1
        runs = plan(h, 64, 6, small)
        filled = {}
        for length, own in runs.items():
            ranks = np.concatenate([np.arange(a, a + n) for a, _, _, n in own])
            assert sorted(ranks) == list(range(h[length]))
            for _, s, o, n in own:
                for k in range(n):
                    filled.setdefault(s + k, []).append((o, length))
        assert sorted(filled) == list(range(sequences(runs)))
        for parts in filled.values():
            at = 0
            for o, length in sorted(parts):
                assert o == at
                at += length
            assert at <= 64


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    h = np.bincount(np.minimum(rng.lognormal(6.5, 1, 20_000).astype(int) % 1024 + 1, 1024), minlength=1025)
    assert sequences(best_plan(h, 1024)) <= 1.003 * (h * np.arange(1025)).sum() / 1024


def test_edges_and_round_trip(spark):
    found = [r.asDict() for r in pack(edges.documents(spark), byte_bpe()).collect()]
    rows = {}
    for r in found:
        rows.setdefault(r["doc_id"], []).append(r)
    for i, text in edges.ROWS:
        own = np.append(ids(byte_bpe(), text), np.uint32(2)).astype("<u4")
        mine = sorted(rows[i], key=lambda r: r["start"])
        copies = sum(x == i for x, _ in edges.ROWS)
        assert sum(r["length"] for r in mine) == copies * len(own)
        for r in mine:
            assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            assert r["piece"] == 0 or r["length"] == 1024
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert pack(edges.documents(spark, []), byte_bpe()).count() == 0
