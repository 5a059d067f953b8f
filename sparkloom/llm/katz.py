"""Katz backoff word models: Good-Turing discounted bigram counts with exactly normalised backoff weights in partitioned tables.

p(w | h) is d c(h, w) / c(h) for a bigram seen in training and a(h) p(w) for any other, p(w) being the
discounted share of w's count and, for all unknown words together, what the discounts leave. a(h)
makes the probabilities after h sum to one. A text's words are followed by one end; before the first
stands a start.

The words' hash range is cut into fragments; a fragment holds its words' counts, backoff weights and
the bigrams that end in them. Nothing that grows with the corpus is broadcast or collected:

1. Tasks count the bigrams of batches of training documents; fragments add them up and give the
   tables, and counts of counts, from which the discounts come.
2. Fragments send, for each history of theirs, the sums over its bigrams to the history's fragment,
   which computes its backoff weight and answers each sender.
3. Documents' tokens are packed by fragment and meet the tables there. A token adds, by its word, the
   lower-order probability and, as the history of what follows, the log of its backoff weight; where
   its bigram is in the table it adds what that is over backing off. Sums go back by document. A
   fragment with a hot word is several here: each has its tables and some batches of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, join_small, lean
from .fragments import exchange, fragment_keys, pack, unpack, word_hashes

U64 = np.uint64
#: Bits and bytes of a word's hash, and those of the start and the end of a text.
BITS, BYTES = 48, 6
START, END = U64(0x56789ABCDE13), U64(0x8ACE13579BD)
#: Counts up to this are discounted. Bigrams are kept from this count on.
MOST_DISCOUNTED, LEAST_KEPT = 5, 1
#: Tokens that are packed at a time, and that one fragment is meant to be met by.
BATCH, FRAGMENT = 1_600_000, 10_000_000


@dataclass(frozen=True)
class Discounts:
    """tokens, words: N and V of training. word, pair: factors for counts 0 to MOST_DISCOUNTED + 1 (the last for all higher ones). unknown: probability of all unknown words."""

    tokens: int
    words: int
    word: np.ndarray
    pair: np.ndarray
    unknown: float


def good_turing(kinds: np.ndarray) -> np.ndarray:
    """Katz's discount factors from kinds[r], how many types are counted r times, r up to MOST_DISCOUNTED + 1."""
    k = MOST_DISCOUNTED
    out = np.ones(k + 2)
    common = (k + 1) * kinds[k + 1] / kinds[1] if kinds[1] else 1.0
    for r in range(1, k + 1):
        if kinds[r] and kinds[r + 1] and common < 1:
            d = ((r + 1) * kinds[r + 1] / (r * kinds[r]) - common) / (1 - common)
            out[r] = d if 0 < d < 1 else r / (r + 1)
        else:
            out[r] = r / (r + 1)
    return out


def discounts(tokens: int, words: int, mass: np.ndarray, word_kinds: np.ndarray, pair_kinds: np.ndarray) -> Discounts:
    """mass[r]: tokens of words counted r times, the last of all higher ones."""
    word = good_turing(word_kinds)
    known = float((word * mass).sum()) / max(tokens, 1)
    if 1 - known < 1 / (tokens + 1):
        word = word * (tokens / (tokens + 1)) / max(known, 1e-300) if tokens else word
        known = tokens / (tokens + 1)
    return Discounts(tokens, words, word, good_turing(pair_kinds), 1 - known)


def _class(count: np.ndarray) -> np.ndarray:
    return np.minimum(count, MOST_DISCOUNTED + 1)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text start, words and end: hash, the one before, and text."""
    words, of = word_hashes(texts)
    n = len(texts)
    count = np.bincount(of, minlength=n)
    first = np.cumsum(count + 2) - (count + 2)
    out = np.full(int((count + 2).sum()), END, U64)
    out[first] = START
    out[first[of] + 1 + np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)] = words >> U64(64 - BITS)
    before = np.concatenate([[U64(0)], out[:-1]])
    before[first] = 0
    return out, before, np.repeat(np.arange(n, dtype=np.int32), count + 2)


def _grouped(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and an order of all tokens by word and then the one before, and each token's word in that order."""
    kinds, at = np.unique(words, return_inverse=True)
    at = at.astype(np.int32)
    low = 64 - max(1, int(len(kinds)).bit_length())
    order = np.argsort((at.astype(U64) << U64(low)) | (before >> U64(max(0, BITS - low))))
    return kinds, order, at[order]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _short(times: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, and those over 254 in full."""
    return np.minimum(times, 255).astype(np.uint8).tobytes(), times[times > 254].astype("<u4").tobytes()


def _long(short: bytes, over: bytes) -> np.ndarray:
    times = np.frombuffer(short, np.uint8).astype(np.int32)
    times[times == 255] = np.frombuffer(over, "<u4")
    return times


class _Cut:
    """The hash range in a power of two of fragments."""

    def __init__(self, count: int, keys: np.ndarray):
        self.count, self.keys = count, keys
        self.shift = BITS - int(np.log2(count))

    def ends(self, ordered: np.ndarray) -> np.ndarray:
        return np.searchsorted(ordered, np.arange(self.count + 1).astype(U64) << U64(self.shift)) if len(ordered) else np.zeros(self.count + 1, int)


FIELDS = ("words", "counts", "pairs", "before", "times", "docs", "extra")
PACKED = "fragment int, kind int, part int, " + ", ".join(f"{f} binary" for f in FIELDS)


def _pack_pairs(before: np.ndarray) -> bytes:
    """Hashes of pairs' histories: the distinct ones once, and each pair's place among them."""
    kinds, at = np.unique(before, return_inverse=True)
    return len(kinds).to_bytes(4, "little") + pack(kinds, BYTES) + pack(at, _width(len(kinds)))


def _unpack_pairs(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return unpack(data[4 : 4 + n * BYTES], BYTES)[unpack(data[4 + n * BYTES :], _width(n)).astype(np.int64)]


def _width(n: int) -> int:
    return max(1, (max(n - 1, 0).bit_length() + 7) // 8)


def _open(row: dict) -> dict:
    """A row with its fields as _row was given them."""
    import pyarrow as pa

    out = dict(row)
    for f in FIELDS:
        v = row.get(f)
        if v is not None:
            size = int.from_bytes(v[:8], "little")
            out[f] = pa.decompress(v[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return out


def _row(cut_: _Cut, f: int, kind: int, part: int = 0, key: int | None = None, **fields: bytes):
    """A row for a fragment, by its key unless another is given; its fields are compressed by themselves, which takes less of the shuffle than Spark's codec alone."""
    import pyarrow as pa

    fields = {k: len(v).to_bytes(8, "little") + (pa.compress(v, codec="zstd", asbytes=True) if v else b"") for k, v in fields.items()}
    return pa.RecordBatch.from_pydict({"fragment": pa.array([int(cut_.keys[f] if key is None else key)], pa.int32()), "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32())} | {k: pa.array([fields.get(k)], pa.binary()) for k in FIELDS})


def _batches(batches, columns: tuple[str, ...]):
    """Texts of a partition in batches of about BATCH tokens: the other columns as arrays, then _tokens()."""
    held, texts, size, total = {c: [] for c in columns}, [], 0, 0
    for batch in batches:
        others = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        for start, part in chunks(t.as_py() or "" for t in batch.column("text")):
            got = _tokens(part)
            for c in columns:
                held[c].append(others[c][start : start + len(part)])
            texts.append((got[0], got[1], got[2] + np.int32(total)))
            size, total = size + len(got[0]), total + len(part)
            if size >= BATCH or total >= 50_000:
                yield [np.concatenate(held[c]) for c in columns], *map(np.concatenate, zip(*texts, strict=True))
                held, texts, size, total = {c: [] for c in columns}, [], 0, 0
    if texts:
        yield [np.concatenate(held[c]) for c in columns], *map(np.concatenate, zip(*texts, strict=True))


def count_tables(training: DataFrame, cut_: _Cut) -> DataFrame:
    """A row for each fragment: its words and their counts, its kept bigrams (how many of each word, histories, times), and counts of counts."""

    def packed(batches):
        for _, words, before, _ in _batches(batches, ()):
            kinds, order, at = _grouped(words, before)
            before = before[order]
            start = _runs(at, before)
            times = np.diff(start, append=len(at))
            at, before = at[start], before[start]
            per_word = np.bincount(at, minlength=len(kinds))
            ends = cut_.ends(kinds)
            pair_ends = np.concatenate([[0], np.cumsum(per_word)])[ends]
            for f in range(cut_.count):
                a, b = ends[f], ends[f + 1]
                i, j = pair_ends[f], pair_ends[f + 1]
                if a < b:
                    yield _row(cut_, f, 0, words=pack(kinds[a:b], BYTES), pairs=per_word[a:b].astype("<u4").tobytes(), before=_pack_pairs(before[i:j]), **dict(zip(("times", "counts"), _short(times[i:j]), strict=True)))

    def reduce(held):
        held = [_open(r) for r in held]
        all_words = [unpack(r["words"], BYTES) for r in held]
        kinds = np.unique(np.concatenate(all_words))
        place = np.concatenate([np.repeat(np.searchsorted(kinds, w).astype(np.int32), np.frombuffer(r["pairs"], "<u4")) for w, r in zip(all_words, held, strict=True)])
        before = np.concatenate([_unpack_pairs(r["before"]) for r in held])
        times = np.concatenate([_long(r["times"], r["counts"]) for r in held])
        del all_words
        order = np.lexsort((before, place))
        place, before, times = place[order], before[order], times[order]
        del order
        start = _runs(place, before)
        times = np.add.reduceat(times, start, dtype=np.int64)
        place, before = place[start], before[start]
        counts = np.bincount(place, times, len(kinds)).astype(np.int64)
        token = kinds != START
        real = token[place]
        top = MOST_DISCOUNTED + 2
        stats = np.concatenate([[counts[token].sum(), token.sum()], np.bincount(_class(counts[token]), counts[token], top), np.bincount(np.minimum(counts[token], top), minlength=top + 1)[:top], np.bincount(np.minimum(times[real], top), minlength=top + 1)[:top], [counts.sum()]])
        keep = real & (times >= LEAST_KEPT)
        f = int(kinds[0] >> U64(cut_.shift))
        yield _row(cut_, f, 1, f, words=pack(kinds, BYTES), counts=counts.astype("<i8").tobytes(), pairs=np.bincount(place[keep], minlength=len(kinds)).astype("<u4").tobytes(), before=_pack_pairs(before[keep]), times=times[keep].astype("<u4").tobytes(), extra=stats.astype("<f8").tobytes())

    return cut(exchange(training.select("text").mapInArrow(lean(packed), PACKED), cut_.count, reduce, PACKED))


def discounts_of(tables: DataFrame) -> tuple[Discounts, dict[int, int]]:
    """From the fragments' counts of counts, a row of a few numbers from each; and how many training tokens and starts each fragment has."""
    top = MOST_DISCOUNTED + 2
    total, loads = np.zeros(2 + 3 * top), {}
    for r in tables.select("part", "extra").toLocalIterator():
        own = np.frombuffer(_open({"extra": r["extra"]})["extra"], "<f8")
        total += own[:-1]
        loads[r["part"]] = int(own[-1])
    return discounts(int(total[0]), int(total[1]), total[2 : 2 + top], total[2 + top : 2 + 2 * top], total[2 + 2 * top :]), loads


class _Spread:
    """Fragments that twice the tokens meet that one is meant for are several: their tables go to each, batches of documents to one of them in turn.

    keys: of each fragment its own key and those beside it. Without such fragments nothing changes.
    """

    def __init__(self, spark, cut_: _Cut, loads: dict[int, int], share: float):
        self.spark, spare = spark, iter(range(-1, -(1 << 31), -1))  # keys of fragments are not negative
        parts = [max(1, int(loads.get(f, 0) * share / FRAGMENT)) for f in range(cut_.count)]
        self.keys = [[int(cut_.keys[f]), *[next(spare) for _ in range(parts[f] - 1)]] for f in range(cut_.count)]

    def tables(self, rows: DataFrame) -> DataFrame:
        many = [(own[0], key) for own in self.keys if len(own) > 1 for key in own]
        if not many:
            return rows
        of = self.spark.createDataFrame(many, "fragment int, _key int")
        columns = [c for c in rows.columns if c != "fragment"]
        return join_small(rows, of, "fragment", "left").select(F.coalesce("_key", "fragment").alias("fragment"), *columns)


def _word_share(d: Discounts, counts: np.ndarray) -> np.ndarray:
    return d.word[_class(counts)] * counts / max(d.tokens, 1)


def backoff_tables(tables: DataFrame, d: Discounts, cut_: _Cut) -> DataFrame:
    """Rows for the fragments: of their words (kind 2) count and log10 backoff weight, of the histories of their bigrams (kind 3) log10 of denominator times backoff weight."""

    def ask(batches):
        for batch in batches:
            for r in map(_open, batch.to_pylist()):
                kinds, counts = unpack(r["words"], BYTES), np.frombuffer(r["counts"], "<i8")
                yield _row(cut_, r["part"], 2, r["part"], words=r["words"], counts=r["counts"])
                before, times = _unpack_pairs(r["before"]), np.frombuffer(r["times"], "<u4").astype(np.int64)
                if not len(before):
                    continue
                share = _word_share(d, counts)[np.repeat(np.arange(len(kinds)), np.frombuffer(r["pairs"], "<u4"))]
                histories, at = np.unique(before, return_inverse=True)
                seen = np.bincount(at, d.pair[_class(times)] * times)
                lower = np.bincount(at, share)
                ends = cut_.ends(histories)
                for f in range(cut_.count):
                    a, b = ends[f], ends[f + 1]
                    if a < b:
                        yield _row(cut_, f, 3, r["part"], before=pack(histories[a:b], BYTES), times=seen[a:b].tobytes(), extra=lower[a:b].tobytes())

    def answer(held):
        held = [_open(r) for r in held]
        kinds = np.concatenate([unpack(r["words"], BYTES) for r in held if r["kind"] == 2] or [np.zeros(0, U64)])
        counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in held if r["kind"] == 2] or [np.zeros(0, np.int64)])
        f = int(np.flatnonzero(cut_.keys == held[0]["fragment"])[0])
        order = np.argsort(kinds)
        kinds, counts = kinds[order], counts[order]
        seen, lower = np.zeros(len(kinds)), np.zeros(len(kinds))
        asked = []
        for r in held:
            if r["kind"] == 3 and len(kinds):
                h = unpack(r["before"], BYTES)
                at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
                hit = kinds[at] == h
                np.add.at(seen, at[hit], np.frombuffer(r["times"])[hit])
                np.add.at(lower, at[hit], np.frombuffer(r["extra"])[hit])
                asked.append((r["part"], h[hit], at[hit]))
        over = np.where(seen > counts - 0.5, counts + 1.0, counts)  # nothing left for other words: one more event
        weight = np.where(seen > 0, np.log10((1 - seen / np.maximum(over, 1)) / np.maximum(1 - lower, 1e-12)), 0.0)
        if len(kinds):
            yield _row(cut_, f, 2, f, words=pack(kinds, BYTES), counts=counts.astype("<i8").tobytes(), extra=weight.tobytes())
        for part, h, at in asked:
            if len(h):
                yield _row(cut_, part, 3, f, before=pack(h, BYTES), extra=(np.log10(np.maximum(over, 1)) + weight)[at].tobytes())

    return exchange(tables.select("part", "words", "counts", "pairs", "before", "times").mapInArrow(lean(ask), PACKED), cut_.count, answer, PACKED)


def score_texts(documents: DataFrame, tables: DataFrame, backoff: DataFrame, d: Discounts, cut_: _Cut, spread: _Spread) -> DataFrame:
    """Rows (key, rows, n_tokens, n_known, base_score, score) of documents' (key, text), summed over the rows of a key."""
    n_all = d.tokens + d.words + 1
    own_keys = spread.keys

    def packed(batches):
        for turn, ((keys,), words, before, of) in enumerate(_batches(batches, ("key",))):
            kinds, order, at = _grouped(words, before)
            before, of = before[order], of[order]
            start = _runs(at, before)
            times = np.diff(start, append=len(at))
            per_word = np.bincount(at[start], minlength=len(kinds))
            ends = cut_.ends(kinds)
            pair_ends = np.concatenate([[0], np.cumsum(per_word)])
            token_ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(kinds)))])
            for f in range(cut_.count):
                a, b = ends[f], ends[f + 1]
                if a == b:
                    continue
                i, j, x, y = pair_ends[a], pair_ends[b], token_ends[a], token_ends[b]
                used, place = np.unique(of[x:y], return_inverse=True)
                short, over = _short(times[i:j])
                many = per_word[a:b]
                yield _row(cut_, f, 4, key=own_keys[f][turn % len(own_keys[f])], words=pack(kinds[a:b], BYTES), pairs=many.astype("<u4").tobytes(), before=_pack_pairs(before[start[i:j]]), times=short, counts=over, docs=place.astype("<u2").tobytes(), extra=keys[used].astype("<i8").tobytes())

    def reduce(held):
        import pyarrow as pa

        kinds = counts = weight = None
        of_h: list[tuple[np.ndarray, np.ndarray]] = []
        model = None
        for r in held:
            if r["kind"] == 4:
                continue
            r = _open(r)
            if r["kind"] == 2:
                kinds, counts, weight = unpack(r["words"], BYTES), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["extra"])
            elif r["kind"] == 3:
                of_h.append((unpack(r["before"], BYTES), np.frombuffer(r["extra"])))
            elif r["kind"] == 1:
                model = r
        if kinds is None:
            kinds, counts, weight = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0)
        share = np.log10(np.maximum(_word_share(d, counts), 1e-300))
        base = np.log10((counts + 1) / n_all)
        bits = U64(64 - max(1, len(kinds).bit_length()))
        cutoff = U64(max(0, BITS - int(bits)))
        pair_key, bonus = np.zeros(0, U64), np.zeros(0)
        if model is not None and len(model["before"]):
            place = np.repeat(np.arange(len(kinds)), np.frombuffer(model["pairs"], "<u4"))
            before, times = _unpack_pairs(model["before"]), np.frombuffer(model["times"], "<u4").astype(np.int64)
            h, value = (np.concatenate(c) for c in zip(*of_h, strict=True))
            order = np.argsort(h)
            at = order[np.minimum(np.searchsorted(h[order], before), len(h) - 1)]
            bonus = np.log10(d.pair[_class(times)] * times) - value[at] - share[place]
            pair_key = (place.astype(U64) << bits) | (before >> cutoff)
        unknown = np.log10(d.unknown), np.log10(1 / n_all)
        for r in held:
            if r["kind"] != 4:
                continue
            r = _open(r)
            words, per_word = unpack(r["words"], BYTES), np.frombuffer(r["pairs"], "<u4")
            times = _long(r["times"], r["counts"])
            if len(kinds):
                at = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
                known = kinds[at] == words
            else:
                at, known = np.zeros(len(words), int), np.zeros(len(words), bool)
            start = words == START
            last = words == END
            low = np.where(known, share[at] if len(kinds) else 0.0, unknown[0])
            after = np.where(known, weight[at] if len(kinds) else 0.0, 0.0)
            flat = np.where(known, base[at] if len(kinds) else 0.0, unknown[1])
            word = np.repeat(np.arange(len(words)), per_word)
            value = np.where(start, 0.0, low)[word] + np.where(last, 0.0, after)[word]
            if len(pair_key):
                key = (at[word].astype(U64) << bits) | (_unpack_pairs(r["before"]) >> cutoff)
                where = np.minimum(np.searchsorted(pair_key, key), len(pair_key) - 1)
                value = value + np.where(known[word] & ~start[word] & (pair_key[where] == key), bonus[where], 0.0)
            docs = np.frombuffer(r["docs"], "<u2").astype(np.int64)
            keys = np.frombuffer(r["extra"], "<i8")
            word = np.repeat(word, times)
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys), pa.array(np.bincount(docs, start[word], n).astype(np.int64)), pa.array(np.bincount(docs, ~start[word], n).astype(np.int64)), pa.array(np.bincount(docs, (known & ~start)[word], n).astype(np.int64)),
                    pa.array(np.bincount(docs, np.where(start, 0.0, flat)[word], n)), pa.array(np.bincount(docs, np.repeat(value, times), n)),
                ],
                ["key", "rows", "n_tokens", "n_known", "base_score", "score"],
            )

    rows = documents.mapInArrow(lean(packed), PACKED).union(spread.tables(tables.withColumn("extra", F.lit(None).cast("binary")))).union(spread.tables(backoff))
    got = exchange(rows, max(cut_.count, sum(map(len, own_keys))), reduce, "key long, rows long, n_tokens long, n_known long, base_score double, score double")
    return got.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base_score", "score")])


def score_documents(documents: DataFrame, held_out, fragments: int | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    held_out is a column; the other rows are learned from. A null text is an empty one, of one token,
    the end. Rows with equal ids and texts have equal results, a null id is an id, and rows whose
    held_out is null are learned from. Columns beside doc_id and text are not looked at. Without
    training rows every token is unknown. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    chars, learned = (n or 0 for n in rows.agg(F.sum(F.octet_length("text")), F.sum(F.when(~F.col("held_out"), F.octet_length("text")))).first())
    if fragments is None:
        fragments = 1 << max(3, int(np.ceil(np.log2(max(1, chars / 6 / FRAGMENT)))))
    cut_ = _Cut(fragments, fragment_keys(spark, fragments))
    tables = count_tables(rows.where("not held_out"), cut_)
    d, loads = discounts_of(tables)
    spread = _Spread(spark, cut_, loads, chars / max(1, learned))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    scored = score_texts(keyed.select("key", "text"), tables, backoff_tables(tables, d, cut_), d, cut_, spread)
    out = keyed.select("doc_id", "held_out", "key").join(scored, "key")
    each = [(F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n_tokens", "n_known")]
    return out.select("doc_id", "held_out", *each, F.lit(d.tokens).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))
