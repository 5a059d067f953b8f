"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

1. Tasks pack their documents' distinct shingles by fragment of the hash range. In each fragment those
   that occur in one document only are counted; a document of which more than a fifth are its own can
   have no partner. Documents with equal sets are one node.
2. The nodes left are packed again; each fragment counts in how many nodes its shingles occur. Rarest
   first is the global order. A node keeps its shared shingles in that order and its prefix: two
   similar sets share one of their first |s| - ceil(0.8 |s|) + 1 shingles.
3. The nodes of one prefix shingle, in runs of bounded length, are tied to their neighbours by size
   and to the run's first node. All similar pairs lie within the clusters of what is tied.
4. The shared shingles of a cluster are cut into fragments of the order, fragments count the overlaps
   of pairs separately, and a pair's counts are summed. Where a cluster fits in a task, its fragments
   are counted and summed there for all its pairs and only a spanning forest of the links goes on.
   In larger clusters the tied pairs are verified first, fragments being spread over tasks, which
   joins most groups of copies; of the others only pairs that then lie in different components are
   made, so that no link between components is lost though a group's pairs are not all made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, components, cut, fresh, lean
from .fragments import TOKEN_BITS, exchange, fragment_keys, pack, shingles, unpack

U64 = np.uint64
#: Postings that are packed at a time, and that one fragment is meant to hold.
BATCH, FRAGMENT = 1_000_000, 3_000_000
#: Nodes of one run of a prefix shingle's nodes.
RUN = 1024
#: Bits of the filter of nodes that spares others' texts the shuffle: 4 MB, whatever the input.
FILTER_BITS = 25
NONE = 0xFFFF
#: Clusters of up to so many nodes and shared shingles are joined in one task, without a row per pair.
MOST_NODES, MOST_SHINGLES = 4096, 4_000_000


def _width(fragments: int) -> int:
    return (TOKEN_BITS - int(np.log2(fragments)) + 7) // 8


def _frequency_code(n: np.ndarray) -> np.ndarray:
    """Ten bits that grow with n: n itself up to 512, then sixteen steps for each doubling."""
    big = 512 + np.floor(16 * np.log2(np.maximum(n, 512) / 512)).astype(np.int64)
    return np.minimum(np.where(n < 512, n, big), 1023).astype(U64)


class _Batches:
    """Texts in batches of about BATCH shingles and at most 50,000 documents and a chunk."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, batches):
        """Of (doc_id, rid, text): ids as (doc_id, rid), shingles, and how many each text has."""
        held_ids, held, sizes, total = [], [], [], 0
        for batch in batches:
            names = list(zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), strict=True))
            for start, part in _parts(batch.column("text")):
                tokens, size = shingles(part, self.n)
                held_ids += names[start : start + len(part)]
                held.append(tokens)
                sizes.append(size)
                total += len(tokens)
                if total >= BATCH or len(held_ids) >= 50_000:
                    yield held_ids, np.concatenate(held), np.concatenate(sizes)
                    held_ids, held, sizes, total = [], [], [], 0
        if held_ids:
            yield held_ids, np.concatenate(held), np.concatenate(sizes)


def _parts(column):
    """chunks() of an Arrow column, with null as empty."""
    return chunks(t.as_py() or "" for t in column)


def _set_keys(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each document's set."""
    from .charlm import mix

    out = np.zeros(len(sizes), U64)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(mix(tokens + U64(1)), first)
    return mix(out + sizes.astype(U64)).view(np.int64)


def _fragments(texts: DataFrame, shingle_share: float = 5.5) -> int:
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(4, int(np.ceil(np.log2(max(1, chars / shingle_share / FRAGMENT)))))


def _identified(documents: DataFrame) -> DataFrame:
    """(doc_id, rid, text); rid is a 64-bit hash of id and text, which a null id has too."""
    number = F.col("doc_id").cast("long")
    return documents.select(number.alias("doc_id"), F.xxhash64(number, "text").alias("rid"), "text")


def document_sets(documents: DataFrame, n: int) -> DataFrame:
    """Rows (key, doc_id, rid, n_shingles, own, rows): of each distinct document its set's key and size, how many of its shingles no other row has, and how many rows it has."""
    spark = documents.sparkSession
    rows = _identified(documents)
    count = _fragments(rows)
    keys, shift, width = fragment_keys(spark, count), U64(TOKEN_BITS - int(np.log2(count))), _width(count)
    batched = _Batches(n)

    def row(fragment, batch, **fields):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"fragment": pa.array([int(fragment)], pa.int32()), "batch": pa.array([batch], pa.int64())} | {c: pa.array([fields.get(c)], pa.list_(pa.int64()) if c == "ids" else pa.binary()) for c in ("ids", "rids", "sets", "sizes", "docs", "refs", "tokens")})

    def packed(batches):
        from pyspark import TaskContext

        # The number of a batch is the same when a lost task runs again.
        for turn, (ids, tokens, sizes) in enumerate(batched(batches)):
            batch = (TaskContext.get().partitionId() << 32) + turn
            yield row(keys[batch % count], batch, ids=[i for i, _ in ids], rids=np.array([r for _, r in ids], np.int64).tobytes(), sets=_set_keys(tokens, sizes).tobytes(), sizes=sizes.tobytes())
            of = np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(tokens)
            tokens, of = tokens[order], of[order]
            new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            single = np.diff(at, append=len(tokens)) == 1
            tokens, of = tokens[at], np.where(single, of[at], NONE)
            ends = np.searchsorted(tokens, (np.arange(count + 1).astype(U64) << shift))
            for f in range(count):
                a, b = ends[f], ends[f + 1] if f + 1 < count else len(tokens)
                if a < b:
                    yield row(keys[f], batch, refs=of[a:b].astype("<u2").tobytes(), tokens=pack(tokens[a:b] & ((U64(1) << shift) - U64(1)), width))

    def reduce(held):
        postings = [r for r in held if r["tokens"] is not None]
        for r in held:
            if r["tokens"] is None:
                yield row(0, r["batch"], **{c: r[c] for c in ("ids", "rids", "sets", "sizes")})
        if not postings:
            return
        numbers = [r["batch"] for r in postings]
        tokens = np.concatenate([unpack(r["tokens"], width) for r in postings])
        refs = np.concatenate([np.frombuffer(r["refs"], "<u2") for r in postings])
        of = np.repeat(np.arange(len(postings), dtype=np.int32), [len(r["refs"]) // 2 for r in postings])
        postings.clear()
        held.clear()
        order = np.argsort(tokens)
        tokens = tokens[order]
        differs = tokens[1:] != tokens[:-1]
        alone = np.concatenate([[True], differs]) & np.concatenate([differs, [True]])
        del tokens, differs
        alone = np.sort(order[alone])
        del order
        alone = alone[refs[alone] != NONE]
        refs, of = refs[alone], of[alone]
        ends = np.searchsorted(of, np.arange(len(numbers) + 1))
        for k, batch in enumerate(numbers):
            docs, n = np.unique(refs[ends[k] : ends[k + 1]], return_counts=True)
            if len(docs):
                yield row(0, batch, docs=docs.astype("<u2").tobytes(), sizes=n.astype("<u4").tobytes())

    def summed(held):
        import pyarrow as pa

        first = next(r for r in held if r["sets"] is not None)
        own = np.zeros(len(first["ids"]), np.int64)
        for r in held:
            if r["sets"] is None:
                own[np.frombuffer(r["docs"], "<u2")] += np.frombuffer(r["sizes"], "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(first["sets"], np.int64)), pa.array(first["ids"], pa.int64()), pa.array(np.frombuffer(first["rids"], np.int64)), pa.array(np.frombuffer(first["sizes"], np.int64)), pa.array(own)], ["key", "doc_id", "rid", "n_shingles", "own"])

    schema = "fragment int, batch long, ids array<long>, rids binary, sets binary, sizes binary, docs binary, refs binary, tokens binary"
    counted = exchange(rows.mapInArrow(lean(packed), schema), count, reduce, schema)
    # Each batch's counts come together again: a row for each fragment and batch, not for each document.
    found = exchange(counted.drop("fragment", "refs", "tokens").withColumnRenamed("batch", "fragment"), count, summed, "key long, doc_id long, rid long, n_shingles long, own long")
    return cut(found.groupBy("key", "doc_id", "rid", "n_shingles").agg(F.sum("own").alias("own"), F.count("*").alias("rows")))


def _sifted(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (rid, text) that may be among nodes' rid column: those that a filter of fixed size lets through.

    Beyond some tens of millions of nodes the filter lets most rows through; it then spares less shuffle
    but loses nothing.
    """
    mask = (1 << FILTER_BITS) - 1

    def places(column):
        h = F.xxhash64(F.lit("filter"), column)
        return F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(F.lit(mask)))

    bits = nodes.select(F.explode(places(F.col("rid"))).alias("p")).groupBy((F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in bits:
        table[r["word"]] = r["bits"]
    shared = nodes.sparkSession.sparkContext.broadcast(table)

    def sift(batches):
        import pyarrow as pa

        for batch in batches:
            p = batch.column("places").flatten().to_numpy().reshape(-1, 2)
            hit = ((shared.value[p >> 6] >> (p & 63)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in batch.columns[:2]], ["rid", "text"])

    return _identified(documents).select("rid", "text", places(F.col("rid")).alias("places")).mapInArrow(lean(sift), "rid long, text string")


def ordered_sets(documents: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (node, n, shared, prefix): each node's shingles that other nodes have too as a packed list of order << 54 | shingle, rarest first, and its prefix of these."""
    spark = documents.sparkSession
    texts = _sifted(documents, nodes).join(nodes.select("rid", "node").hint("merge"), "rid")  # a stage of its own: two Python workers a task would hold twice the memory
    total = nodes.agg(F.sum("n")).first()[0] or 0
    count = 1 << max(3, int(np.ceil(np.log2(max(1, total / (FRAGMENT / 2))))))
    keys, shift, width = fragment_keys(spark, count), U64(TOKEN_BITS - int(np.log2(count))), _width(count)

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("node").to_numpy()
            for start, part in _parts(batch.column("text")):
                tokens, sizes = shingles(part, n)
                right = _set_keys(tokens, sizes) == ids[start : start + len(part)]  # hashes of rows may collide
                tokens, sizes = tokens[np.repeat(right, sizes)], np.where(right, sizes, 0)
                of = np.repeat(np.arange(len(part)), sizes)
                order = np.argsort(tokens, kind="stable")
                tokens, of = tokens[order], of[order]
                ends = np.searchsorted(tokens, (np.arange(count + 1).astype(U64) << shift))
                ends[-1] = len(tokens)
                for f in range(count):
                    a, b = ends[f], ends[f + 1]
                    if a < b:
                        used, refs = np.unique(of[a:b], return_inverse=True)
                        yield pa.RecordBatch.from_pydict({"fragment": pa.array([int(keys[f])], pa.int32()), "part": pa.array([f], pa.int32()), "ids": [ids[start + used].tobytes()], "refs": [refs.astype("<u4").tobytes()], "tokens": [pack(tokens[a:b] & ((U64(1) << shift) - U64(1)), width)]})

    def reduce(held):
        import pyarrow as pa

        high = U64(held[0]["part"]) << shift
        tokens = np.concatenate([unpack(r["tokens"], width) for r in held])
        base = np.cumsum([0, *[len(r["ids"]) // 8 for r in held]])
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in held])
        own, place = np.unique(ids, return_inverse=True)
        refs = place[np.concatenate([np.frombuffer(r["refs"], "<u4").astype(np.int64) + b for r, b in zip(held, base, strict=False)])]
        order = np.lexsort((refs, tokens))
        tokens, refs = tokens[order], refs[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (refs[1:] != refs[:-1])])
        tokens, refs = tokens[fresh], refs[fresh]
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n_nodes = np.repeat(np.diff(at, append=len(tokens)), np.diff(at, append=len(tokens)))
        keep = n_nodes > 1
        value = (_frequency_code(n_nodes[keep]) << U64(TOKEN_BITS)) | tokens[keep] | high
        refs = refs[keep]
        order = np.argsort(refs, kind="stable")
        value, refs = value[order], refs[order]
        start = np.flatnonzero(np.concatenate([[True], refs[1:] != refs[:-1]])) if len(refs) else np.zeros(0, int)
        end = np.append(start[1:], len(refs))
        for a in range(0, len(start), 5000):
            yield pa.RecordBatch.from_pydict({"node": own[refs[start[a : a + 5000]]], "part": [value[i:j].tobytes() for i, j in zip(start[a : a + 5000], end[a : a + 5000], strict=True)]})

    shuffled = texts.mapInArrow(lean(packed), "fragment int, part int, ids binary, refs binary, tokens binary")
    parts = exchange(shuffled, count, reduce, "node long, part binary")
    whole = parts.groupBy("node").agg(F.collect_list("part").alias("parts")).join(nodes.select("node", "n"), "node")

    def order(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"node": [], "n": [], "shared": [], "prefix": []}
            for node, parts, size in zip(batch.column("node").to_pylist(), batch.column("parts"), batch.column("n").to_pylist(), strict=True):
                value = np.sort(np.frombuffer(b"".join(parts.as_py()), U64))
                least = -(-percent * size // 100)
                if len(value) < least:
                    continue
                first = size - least + 1 - (size - len(value))
                out["node"].append(node)
                out["n"].append(size)
                out["shared"].append(value.tobytes())
                out["prefix"].append(value[:first].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["shared"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64()))], ["node", "n", "shared", "prefix"])

    return cut(whole.mapInArrow(lean(order), "node long, n long, shared binary, prefix array<long>"))


def verified(pairs: DataFrame, sets: DataFrame, clusters: DataFrame, percent: int, least_parts: int = 4) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets are similar, as (a, b): overlaps counted by fragment of the order and summed.

    A cluster's shingles are cut into least_parts fragments at least and into more where they are many.
    """
    mass = clusters.join(sets.select("node", F.octet_length("shared").alias("bytes")), "node").groupBy("component").agg(F.sum("bytes").alias("bytes"))
    mass = cut(mass.withColumn("parts", F.greatest(F.lit(least_parts), F.ceil(F.col("bytes") / (8 * FRAGMENT / 2)).cast("int"))))
    every = mass.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, int(every // (8 * FRAGMENT / 4)) + 1)
    of = clusters.join(mass.select("component", "parts"), "component").select("node", "component", "parts")
    low = U64((1 << TOKEN_BITS) - 1)

    def cut_up(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"cell": [], "node": [], "v": [], "tokens": []}
            for node, component, parts, shared in zip(*[batch.column(c).to_pylist() for c in ("node", "component", "parts", "shared")], strict=True):
                tokens = np.sort(np.frombuffer(shared, U64) & low)
                ends = np.searchsorted(tokens, [U64((v << TOKEN_BITS) // parts) for v in range(1, parts)])
                for v, own in enumerate(np.split(tokens, ends)):
                    out["cell"].append(component)
                    out["node"].append(node)
                    out["v"].append(v)
                    out["tokens"].append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["cell"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["v"], pa.int32()), pa.array(out["tokens"], pa.binary())], ["cell", "node", "v", "tokens"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = sets.select("node", "shared").join(needed, "node").join(of, "node").mapInArrow(lean(cut_up), "cell long, node long, v int, tokens binary")
    asked = pairs.join(of.withColumnRenamed("node", "a"), "a").select(F.col("component").alias("cell"), F.col("a").alias("node"), F.explode(F.expr("sequence(0, parts - 1)")).alias("v"), F.lit(None).cast("binary").alias("tokens"), "b")
    both = held.withColumn("b", F.lit(None).cast("long")).unionByName(asked).withColumn("fragment", F.pmod(F.xxhash64("cell", "v"), F.lit(tasks)).cast("int"))

    def count(batches):
        import pyarrow as pa

        segments: dict[tuple[int, int], np.ndarray] = {}
        wanted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            node, v, b = batch.column("node").to_numpy(), batch.column("v").to_numpy(), batch.column("b")
            is_pair = b.is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(~is_pair):
                segments[int(node[k]), int(v[k])] = np.frombuffer(batch.column("tokens")[int(k)].as_py(), U64)
            if is_pair.any():
                at = np.flatnonzero(is_pair)
                wanted.append((node[at], b.take(pa.array(at)).to_numpy(), v[at]))
        if not wanted or not segments:
            return
        place = {k: i for i, k in enumerate(segments)}
        size = np.array([len(s) for s in segments.values()])
        first = np.cumsum(size) - size
        flat = np.concatenate(list(segments.values())) if size.sum() else np.zeros(0, U64)
        _, rank = np.unique(flat, return_inverse=True)
        composite = (np.repeat(np.arange(len(size)), size) << 32) | rank
        a, b, v = (np.concatenate(c) for c in zip(*wanted, strict=True))
        left = np.array([place[k] for k in zip(a.tolist(), v.tolist(), strict=True)])
        right = np.array([place[k] for k in zip(b.tolist(), v.tolist(), strict=True)])
        swap = size[left] > size[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        overlap = np.zeros(len(a), np.int64)
        steps = np.cumsum(size[left])
        start = 0
        while start < len(a):
            end = max(start + 1, int(np.searchsorted(steps, (steps[start - 1] if start else 0) + 3_000_000)))
            n = size[left[start:end]]
            where = np.repeat(first[left[start:end]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = (np.repeat(right[start:end], n) << 32) | rank[where]
            at = np.minimum(np.searchsorted(composite, key), len(composite) - 1) if len(composite) else key
            overlap[start:end] = np.bincount(np.repeat(np.arange(end - start), n), composite[at] == key, end - start) if len(key) else 0
            start = end
        some = overlap > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some]), pa.array(overlap[some])], ["a", "b", "overlap"])

    partial = both.repartition(tasks, "fragment").mapInArrow(lean(count), "a long, b long, overlap long")
    total = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap")).join(pairs, ["a", "b"])
    return total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric adjacency matrix."""
    out, left = [], near.any(axis=1)
    while left.any():
        rows = np.array([int(left.argmax())])
        left[rows] = False
        while len(rows):
            at = np.flatnonzero(left)
            reach = near[np.ix_(rows, at)]
            hit = reach.any(axis=0)
            out += zip(rows[reach[:, hit].argmax(axis=0)].tolist(), at[hit].tolist(), strict=True)
            rows = at[hit]
            left[rows] = False
    return out


def similar_pairs(tokens: list[np.ndarray], sizes: np.ndarray, percent: int, width: int = 4096) -> np.ndarray:
    """Adjacency matrix of similar sets among a few: the distinct tokens are cut into fragments of so many, overlaps counted in each and summed."""
    count = np.array([len(t) for t in tokens])
    _, column = np.unique(np.concatenate(tokens), return_inverse=True)
    row = np.repeat(np.arange(len(tokens)), count)
    overlap = np.zeros((len(tokens), len(tokens)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    ends = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width)) if len(column) else [0]
    for a, b in zip(ends, ends[1:], strict=False):
        part = np.zeros((len(tokens), width), np.float32)
        part[row[a:b], column[a:b] % width] = 1
        overlap += part @ part.T
    near = 100 * overlap >= percent * (sizes[:, None] + sizes[None, :] - overlap)
    np.fill_diagonal(near, False)
    return near


def within_clusters(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold the nodes of each cluster together as all links between them do; a cluster has to fit in a task."""
    low = U64((1 << TOKEN_BITS) - 1)

    def links(nodes, sizes, shared):
        import pyarrow as pa

        if len(nodes) > 1:
            tree = _forest(similar_pairs([np.frombuffer(x, U64) & low for x in shared], np.array(sizes), percent))
            if tree:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in tree], pa.int64()), pa.array([nodes[j] for _, j in tree], pa.int64())], ["a", "b"])

    def run(batches):
        current, nodes, sizes, shared = None, [], [], []
        for batch in batches:
            for component, node, n, data in zip(*[batch.column(c) for c in ("component", "node", "n", "shared")], strict=True):
                if component.as_py() != current:
                    yield from links(nodes, sizes, shared)
                    current, nodes, sizes, shared = component.as_py(), [], [], []
                nodes.append(node.as_py())
                sizes.append(n.as_py())
                shared.append(data.as_py())
        yield from links(nodes, sizes, shared)

    rows = sets.select("node", "n", "shared").join(clusters.select("node", "component"), "node").select("component", "node", "n", "shared")
    return rows.repartition("component").sortWithinPartitions("component").mapInArrow(lean(run), "a long, b long")


def _pair(x: str, y: str) -> list:
    """Columns a < b with their sizes from two structs (n, node)."""
    small, large = F.least(f"{x}.node", f"{y}.node"), F.greatest(f"{x}.node", f"{y}.node")
    return [small.alias("a"), large.alias("b"), F.when(F.col(f"{x}.node") == small, F.col(f"{x}.n")).otherwise(F.col(f"{y}.n")).alias("na"), F.when(F.col(f"{x}.node") == small, F.col(f"{y}.n")).otherwise(F.col(f"{x}.n")).alias("nb")]


def similar_components(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of every node that has a similar one."""
    code = F.shiftrightunsigned("token", TOKEN_BITS)
    often = F.when(code < 512, code.cast("double")).otherwise(512 * F.pow(2.0, (code - 512 + 1) / 16))
    listed = sets.select("node", "n", F.explode("prefix").alias("token"))
    listed = cut(listed.withColumn("run", F.pmod(F.xxhash64("node"), F.ceil(often / RUN).cast("long"))).withColumn("x", F.struct("n", "node")))
    run = Window.partitionBy("token", "run").orderBy("x")
    tied = listed.select("token", "run", "x", F.lag("x").over(run).alias("y"), F.first("x").over(run).alias("z"))
    near = tied.where("y is not null").select(F.explode(F.array(F.struct("x", "y"), F.struct("x", F.col("z").alias("y")))).alias("p")).select("p.x", "p.y")
    heads = listed.where(often > RUN).groupBy("token", "run").agg(F.min("x").alias("x"))
    near = near.union(heads.select("x", F.lag("x").over(Window.partitionBy("token").orderBy("x")).alias("y")).where("y is not null"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    candidates = cut(near.select(*_pair("x", "y")).distinct())
    clusters = cut(components(candidates.select("a", "b")))
    mass = clusters.join(sets.select("node", F.octet_length("shared").alias("bytes")), "node").groupBy("component").agg(F.count("*").alias("nodes"), F.sum("bytes").alias("bytes"))
    large = cut(mass.where((F.col("nodes") > MOST_NODES) | (F.col("bytes") > 8 * MOST_SHINGLES)).select("component"))
    if large.isEmpty():
        return components(within_clusters(sets, clusters, percent), forest=True)
    # Clusters that do not fit in a task.
    held = cut(clusters.join(large, "component", "left_anti"))
    together = cut(within_clusters(sets, held, percent))
    clusters = cut(clusters.join(large, "component", "left_semi"))
    sets = sets.join(clusters.select("node"), "node", "left_semi")
    listed = listed.join(clusters.select("node"), "node", "left_semi")
    candidates = cut(candidates.join(clusters.select(F.col("node").alias("a")), "a", "left_semi"))
    links = cut(verified(candidates.where(fits), sets, clusters, percent))
    labels = cut(components(links))
    # Candidates between components: only prefix shingles whose nodes are not all in one.
    of = listed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = of.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    signed = F.lit(-(1 << 63)).cast("long")  # orders packed shingles as unsigned numbers
    whole = sets.select("node", "prefix", (F.element_at("prefix", -1).bitwiseXOR(signed)).alias("last"), ((F.octet_length("shared") / 8).cast("long") - F.size("prefix")).alias("beyond"))
    rest = cut(of.join(split, "token").select("token", "component", "x", "n", "node").join(whole, "node").drop("node"))
    l, r = rest.alias("l"), rest.alias("r")
    # A pair is made at one shingle only. Of two prefixes let one end first: what both sets share lies in
    # both prefixes or beyond that one, which bounds the overlap.
    both = F.array_intersect("l.prefix", "r.prefix")
    most = F.size(both) + F.when(F.col("l.last") <= F.col("r.last"), F.col("l.beyond")).otherwise(F.col("r.beyond"))
    enough = most * (100 + percent) >= percent * (F.col("l.n") + F.col("r.n"))
    crossed = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.component") < F.col("r.component")) & (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")) & enough & (F.array_min(both) == F.col("l.token")))
    more = cut(crossed.select(F.col("l.x").alias("x"), F.col("r.x").alias("y")).select(*_pair("x", "y")).distinct().join(candidates.select("a", "b"), ["a", "b"], "left_anti"))
    found = verified(more, sets, clusters, percent)
    return components(links.union(found).union(together))


def labelled_rows(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, rid, n_shingles, component, rows) of the distinct documents: the component of each one's set, null where the set is empty, and how many rows it has."""
    rows = document_sets(documents, n)
    sets = rows.where("n_shingles > 0").groupBy("key").agg(F.min("rid").alias("rid"), F.max("n_shingles").alias("n"), F.sum("own").alias("own"))
    nodes = cut(sets.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")).select(F.col("key").alias("node"), "rid", "n"))
    tied = similar_components(ordered_sets(documents, nodes, n, percent), percent)
    out = rows.join(tied.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "key")))
    return cut(out.select("doc_id", "rid", F.col("n_shingles").cast("long").alias("n_shingles"), "component", "rows"))


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * overlap >= percent * union of their sets of distinct n-word
    shingles; component_id is the smallest doc_id that links reach. A document without words (or with
    null text) has an empty set and links with nothing. Equal texts link. Rows that share a doc_id are
    one document as far as links go; each row has its own n_shingles. A null doc_id reaches others but
    names no component: where no other is reached, component_id is null. Columns beside doc_id and
    text are not looked at; an empty table gives no rows.
    """
    labelled = labelled_rows(documents, n, percent)
    # A doc_id with several texts ties their components.
    named = labelled.where("component is not null and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("doc_id", "a")
    several = cut(named.join(several, "doc_id").where("a <> component").select("a", F.col("component").alias("b")))
    if not several.isEmpty():
        joined = components(several)
        labelled = labelled.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_joined")), "component", "left").withColumn("component", F.coalesce("_joined", "component"))
        named = labelled.where("component is not null and doc_id is not null")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    each = labelled.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "rows")
    return each.withColumn("_row", F.explode(F.expr("sequence(1L, rows)"))).select("doc_id", "n_shingles", "component_id")


def representatives(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of documents, with all their columns, one row of each group of near-duplicates.

    Groups are of texts: a row belongs to what links reach from its own text, whatever other texts
    share its id. The row with the smallest doc_id stays (null ids come last), of several texts of it
    the one with the smallest hash, of equal rows any one by a hash of the other columns. Rows without words
    are near-duplicates of nothing; of those with one id and text one stays. An empty table gives no rows.
    """
    labelled = labelled_rows(documents, n, percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rows")
    win = labelled.where("component is not null").groupBy("component").agg(F.min(first).alias("w")).select("w.rid", "w.rows")
    win = cut(win.union(labelled.where("component is null").select("rid", "rows")))
    rid, nth = fresh(documents, "_rid"), fresh(documents, "_nth")
    rows = documents.withColumn(rid, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    once = rows.join(win.where("rows = 1").select(F.col("rid").alias(rid)), rid, "left_semi")
    repeated = win.where("rows > 1").select(F.col("rid").alias(rid))
    if not repeated.isEmpty():
        plain = [c for c, kind in documents.dtypes if "map<" not in kind]
        order = Window.partitionBy(rid).orderBy(F.xxhash64(*plain))
        of_several = rows.join(repeated, rid, "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
        once = once.unionByName(of_several)
    return once.drop(rid)
