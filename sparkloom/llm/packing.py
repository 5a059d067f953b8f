"""Best-fit packing by a linear grouping scheme.

The lengths to pack are whole numbers up to the sequence length, so a histogram with as many entries
holds all that planning needs, whatever the number of documents:

1. Large lengths are sorted and cut into groups of equal cardinality; each is rounded up to the
   longest of its group, which leaves few sizes.
2. The few-size problem is solved as a linear program over configurations (which sizes fill one
   sequence), with column generation by a knapsack; whole numbers of each configuration are kept.
3. Actual lengths take the places of the rounded ones, longest first.
4. What is left, the small lengths among it, goes to the place with the least room that fits.

The plan is a list of runs "documents a..b of length l lie at offset o of sequences s.." Documents get
their rank within their length by a distributed running sum and find their run by binary search.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, placed
from .encode import ids


def _configurations(sizes: np.ndarray, need: np.ndarray, room: int, most_columns: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often the linear program uses each: revised simplex with knapsack pricing."""
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / (room // sizes))
    x = inverse @ need
    order = np.argsort(sizes)
    ascending = sizes[order]
    for _ in range(most_columns):
        price = inverse.sum(axis=0)  # dual prices, each sequence costing 1
        gain = np.maximum(price[order], 0)
        best, took = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(int(ascending[0]), room + 1):
            fits = np.searchsorted(ascending, c, side="right")
            with_one = best[c - ascending[:fits]] + gain[:fits]
            k = int(with_one.argmax())
            best[c], took[c] = (with_one[k], k) if with_one[k] > best[c - 1] else (best[c - 1], -1)
        if best[room] <= 1 + 1e-7:
            break
        column, c = np.zeros(m), room
        while c >= ascending[0]:
            if took[c] < 0:
                c -= 1
            else:
                column[order[took[c]]] += 1
                c -= int(ascending[took[c]])
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = x - t * step
        x[out] = t
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        basis[:, out] = column
    return [(basis[:, k].astype(int), float(x[k])) for k in range(m) if x[k] > 1e-9]


def sequences(runs: dict[int, np.ndarray]) -> int:
    """How many sequences a plan fills."""
    return max((int((own[:, 1] + own[:, 3]).max()) for own in runs.values()), default=0)


def best_plan(histogram: np.ndarray, room: int, groups: int = 64) -> dict[int, np.ndarray]:
    """The plan with the fewest sequences over several bounds between small and large lengths.

    Rounding loses room that only small lengths win back, so where few are small the bound must be high.
    """
    return min((plan(histogram, room, groups, bound) for bound in (room // 2, room // 4, room // 8)), key=sequences)


def plan(histogram: np.ndarray, room: int, groups: int = 64, small: int | None = None) -> dict[int, np.ndarray]:
    """For each length an array of runs (first rank, first sequence, offset, count); histogram[l] counts length l, 1 to room.

    groups: sizes after rounding. small: lengths up to this are not grouped (room // 10 unless given).
    """
    small = room // 10 if small is None else small
    left = np.asarray(histogram, dtype=np.int64).copy()
    segments: list[tuple[int, list[int]]] = []  # so many sequences with these lengths, in order
    large = [(length, int(left[length])) for length in range(room - 1, small, -1) if left[length]]
    total = sum(n for _, n in large)
    if left[room]:
        segments.append((int(left[room]), [room]))
        left[room] = 0
    if total:
        each = -(-total // groups)
        rounded: dict[int, list[list[int]]] = defaultdict(list)  # size: [length, count] of its group, longest first
        size, filled = large[0][0], 0
        for length, n in large:
            while n:
                if filled == each:
                    size, filled = length, 0
                take = min(n, each - filled)
                rounded[size].append([length, take])
                filled += take
                n -= take
        sizes = np.array(sorted(rounded, reverse=True))
        need = np.array([float(sum(n for _, n in rounded[s])) for s in sizes])
        for column, times in _configurations(sizes, need, room):
            n = int(times + 1e-6)
            for s, k in zip(sizes, column, strict=True):
                if k:
                    n = min(n, sum(c for _, c in rounded[s]) // int(k))
            if not n:
                continue
            own = [(n, [])]
            for s, k in zip(sizes, column, strict=True):
                for _ in range(int(k)):
                    split = []
                    for count, lengths in own:
                        while count:
                            run = rounded[s][0]
                            take = min(count, run[1])
                            split.append((take, [*lengths, run[0]]))
                            left[run[0]] -= take
                            count -= take
                            run[1] -= take
                            if not run[1]:
                                rounded[s].pop(0)
                    own = split
            segments += own
    open_: list[list[tuple[int, list[int]]]] = [[] for _ in range(room + 1)]
    for count, lengths in segments:
        open_[room - sum(lengths)].append((count, lengths))
    for length in range(room - 1, 0, -1):
        gap, n = length, int(left[length])
        while n:
            while gap <= room and not open_[gap]:
                gap += 1
            if gap > room:
                fits = room // length
                for count, k in ((n // fits, fits), (1, n % fits)):
                    if count and k:
                        open_[room - k * length].append((count, [length] * k))
                break
            count, lengths = open_[gap].pop()
            fits = gap // length
            full = min(count, n // fits)
            if full:
                open_[gap - fits * length].append((full, [*lengths, *[length] * fits]))
                count, n = count - full, n - full * fits
            if count and n < fits and n:
                open_[gap - n * length].append((1, [*lengths, *[length] * n]))
                count, n = count - 1, 0
            if count:
                open_[gap].append((count, lengths))
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranked: dict[int, int] = defaultdict(int)
    sequence = 0
    for own in open_:
        for count, lengths in own:
            offset = 0
            for length in lengths:
                runs[length].append((ranked[length], sequence, offset, count))
                ranked[length] += count
                offset += length
            sequence += count
    return {length: np.array(v, dtype=np.int64) for length, v in runs.items()}


def pieces(documents: DataFrame, tokenizer: str, room: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and end; all pieces but the first are full."""

    def cut_up(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.append(ids(tokenizer, text.as_py()), np.uint32(end)).astype("<u4")
                first = (len(own) - 1) % room + 1
                bounds = [0, *range(first, len(own) + 1, room)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            if rows:
                d, k, a, n, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut_up), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, tokenizer: str, room: int = 1024, end: int = 2, groups: int = 64) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Equal rows are packed separately and a null id is an
    id. Columns beside doc_id and text are not looked at. An empty table gives no rows.
    """
    rows = cut(pieces(documents, tokenizer, room, end))
    histogram = np.zeros(room + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # room rows at most
        histogram[r["length"]] = r["count"]
    runs = best_plan(histogram, room, groups)
    ranked = placed(rows, ["length"], ["doc_id", "piece", "ids_crc32", "start"], F.lit(1), "_rank")

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for own in np.unique(length):
                here = np.flatnonzero(length == own)
                table = runs[int(own)]
                at = np.searchsorted(table[:, 0], rank[here], side="right") - 1
                sequence[here] = table[at, 1] + rank[here] - table[at, 0]
                offset[here] = table[at, 2]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
