"""Hashed words of texts, and the exchange of packed postings by fragment of the hash range.

A row per posting would cost more to shuffle than the text itself. Tasks therefore pack their
postings: one row holds those of one batch of documents and one fragment, as arrays. A fragment is
sized in postings, so what meets in one task is bounded whatever the input, and postings that a batch
holds many times are packed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import mix
from .common import lean

U64 = np.uint64
#: Bits of a hash that identify an n-gram; ten are left for what is kept beside it.
TOKEN_BITS = 54
#: Bytes of one text that are hashed at a time with others.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' words, A-Z lower-cased, in order, and the index of each one's text."""
    coded = [(t or "").encode("utf-8", "replace") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)]
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    by = mix(np.arange(1, int(lengths.max()) + 1, dtype=U64)) | U64(1)
    hashes = mix(np.add.reduceat(_BYTE[data[word]] * by[place], first))
    over = np.cumsum([len(c) + 1 for c in coded])
    return hashes, np.searchsorted(over, starts, side="right")


def shingles(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as sorted TOKEN_BITS-bit hashes, all texts' one after another, and how many each text has.

    A text with fewer words has their whole sequence as its one shingle, one without words none.
    """
    words, of = word_hashes(texts)
    count = np.bincount(of, minlength=len(texts))
    if not len(words):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    by = mix(np.arange(101, 101 + n, dtype=U64)) | U64(1)
    size = len(words)
    grams, whose = np.zeros(0, U64), np.zeros(0, np.int64)
    if size >= n:
        total = np.zeros(size - n + 1, U64)
        for k in range(n):
            total += words[k : size - n + 1 + k] * by[k]
        same = of[: size - n + 1] == of[n - 1 :]
        grams, whose = mix(total[same]), of[: size - n + 1][same]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.cumsum(count) - count
        total = np.array([int((words[first[d] : first[d] + count[d]] * by[: count[d]]).sum(dtype=U64)) for d in short], dtype=U64)
        grams, whose = np.concatenate([grams, mix(total + count[short].astype(U64))]), np.concatenate([whose, short])
    out, sizes = [], np.zeros(len(texts), np.int64)
    low = U64(64 - TOKEN_BITS)
    for start in range(0, len(texts), 1 << (64 - TOKEN_BITS)):
        here = (whose >= start) & (whose < start + (1 << (64 - TOKEN_BITS))) if len(texts) > 1 << (64 - TOKEN_BITS) else slice(None)
        keys = np.sort(((whose[here] - start).astype(U64) << U64(TOKEN_BITS)) | (grams[here] >> low))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        own = (keys >> U64(TOKEN_BITS)).astype(np.int64) + start
        sizes += np.bincount(own, minlength=len(texts))
        out.append(keys & U64((1 << TOKEN_BITS) - 1))
    return np.concatenate(out), sizes


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as so many bytes each, all first bytes first: of sorted values the high bytes hardly change, which compresses."""
    return np.ascontiguousarray(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel().astype(U64, copy=False)


def fragment_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n fragments an int that Spark's hash partitioning deals to a partition of its own, of n."""
    got = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    keys = {r["p"]: r["id"] for r in got}
    spare = iter(range(64 * n + 64, 66 * n + 64))
    return np.array([keys.get(p) if p in keys else next(spare) for p in range(n)], dtype=np.int32)


def exchange(packed: DataFrame, fragments: int, reduce: Callable[[list[dict]], Iterator], schema: str) -> DataFrame:
    """Brings the rows of each value of packed.fragment together: reduce gets them as dicts and yields record batches.

    One fragment is held at a time. reduce must not depend on the order of its rows.
    """
    names = packed.columns

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            columns = [batch.column(c) for c in names]
            for k in range(batch.num_rows):
                row = {c: v[k].as_py() for c, v in zip(names, columns, strict=True)}
                if held and held[0]["fragment"] != row["fragment"]:
                    yield from reduce(held)
                    held = []
                held.append(row)
        if held:
            yield from reduce(held)

    return packed.repartition(fragments, "fragment").sortWithinPartitions("fragment").mapInArrow(lean(run), schema)
