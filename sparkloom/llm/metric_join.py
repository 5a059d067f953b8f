"""Embedding near-duplicates by an exact metric range join.

Cosine c of two vectors is a distance sqrt(2 - 2c) of their unit vectors. Pivots, a bounded sample of
the vectors, partition the space: every vector is at home in the cell of its nearest pivot. A vector x
may have partners y at home in another cell q only if d(x, q) <= radius(q) + r and, as y is nearer to
q than to x's own pivot p, d(x, q) <= d(x, p) + 2r (triangle inequality, r the joined range); it is
replicated to the cells where both hold. Of two cells one, fixed by their numbers, joins the pairs
between them, so a vector goes to half of these cells. Each cell joins by itself. Cells are cut into
blocks of a bounded number of components, so that a crowded cell is many tasks' work.

Equal vectors are one class with a count, so copies are never expanded into pairs. A block returns
counts per vector and a spanning forest of its links, not the links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut

#: Room for rounding where the bounds are compared; links themselves are tested in double precision.
SLACK = 1e-6


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # norms of tiny or huge vectors stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite adjacency matrix as (row, column) pairs."""
    out: list[tuple[int, int]] = []
    row_left, column_left = near.any(axis=1), np.ones(near.shape[1], bool)
    while row_left.any():
        rows = np.array([int(row_left.argmax())])
        row_left[rows] = False
        while len(rows):
            reach = near[rows][:, column_left]
            new = np.flatnonzero(column_left)[reach.any(axis=0)]
            if not len(new):
                break
            out += zip(rows[near[np.ix_(rows, new)].argmax(axis=0)].tolist(), new.tolist(), strict=True)
            column_left[new] = False
            found = near[np.ix_(np.flatnonzero(row_left), new)]
            hit = found.any(axis=1)
            rows = np.flatnonzero(row_left)[hit]
            out += zip(rows.tolist(), new[found[hit].argmax(axis=1)].tolist(), strict=True)
            row_left[rows] = False
    return out


def joins(p: int, q: int, cells: int) -> bool:
    """Whether cell p, and not q, joins the pairs between them; every cell does so for about half of the others."""
    ahead = (q - p) % cells
    return 2 * ahead < cells if 2 * ahead != cells else p < q


def link_embeddings(embeddings: DataFrame, cosine: float = 0.9, pivots: int | None = None, home_block: int | None = None, member_block: int | None = None, seed: int = 7) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows whose vector is null, empty, zero or holds null or non-finite components link with nothing
    and are their own component; so do vectors of another dimension than theirs link only with each
    other. Rows that share a vec_id are one vector if their embeddings are equal and separate vectors
    of one component otherwise. A null vec_id counts as a link but names no component; its own is
    null if it has no other. Columns beside vec_id and embedding are not looked at; an empty table
    gives no rows.
    """
    # Vectors travel as they are stored, single precision as single; comparisons are made in double.
    stored = embeddings.schema["embedding"].dataType.simpleString()
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding") if stored == "array<float>" else F.col("embedding").cast("array<double>")).alias("v"))
    good = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    marked = raw.withColumn("v", F.when(good, F.col("v")))
    classes = cut(marked.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")).withColumn("key", F.xxhash64("v")).withColumn("dim", F.size("v")))
    reach = float(np.sqrt(2 - 2 * cosine))
    if pivots is None:  # finer cells for more vectors
        pivots = min(4096, max(12, classes.count() // 4096))
    # At most `pivots` rows come to the driver, whatever the input.
    sample = classes.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(pivots).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    centers = {d: _unit(v) for d, v in by_dim.items()}

    def cells(v: list) -> tuple[np.ndarray, np.ndarray]:
        x = _unit(v)
        c = centers.get(x.shape[1])
        far = np.sqrt(np.maximum(2 - 2 * x @ c.T, 0)) if c is not None else np.zeros((len(x), 1))
        return x, far

    def homes(batches):
        import pandas as pd

        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                _, far = cells(own["v"].tolist())
                yield pd.DataFrame({"dim": dim, "cell": far.argmin(axis=1), "far": far.min(axis=1)})

    sizes = classes.select("dim", "v").mapInPandas(homes, "dim int, cell int, far double").groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()
    radius: dict[int, dict[int, float]] = {}
    parts: dict[tuple[int, int], int] = {}
    for r in sizes:  # a row per pivot and dimension
        radius.setdefault(r["dim"], {})[r["cell"]] = r["radius"]
        parts[r["dim"], r["cell"]] = max(1, -(-r["n"] // (home_block or max(64, 524_288 // r["dim"]))))

    def routes(v: list, dim: int):
        """For each cell its members among vectors, and which of them are at home there."""
        x, far = cells(v)
        home = far.argmin(axis=1)
        near = far[np.arange(len(x)), home]
        count = far.shape[1]
        for q, r in radius[dim].items():
            mine = np.array([joins(q, h, count) for h in range(count)])
            there = (far[:, q] <= r + reach + SLACK) & (far[:, q] <= near + 2 * reach + SLACK) & mine[home] | (home == q)
            yield q, np.flatnonzero(there), home == q

    def counted(batches):
        import pandas as pd

        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                for q, here, _ in routes(own["v"].tolist(), int(dim)):
                    yield pd.DataFrame({"dim": [int(dim)], "cell": [q], "n": [len(here)]})

    members = {(r["dim"], r["cell"]): max(1, -(-r["n"] // (member_block or max(256, 4_194_304 // r["dim"])))) for r in classes.select("dim", "v").mapInPandas(counted, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()}

    def deal(batches):
        """Home rows of a part go to all blocks of it, members of a part to all blocks of the other side."""
        import pandas as pd

        columns = ["key", "n", "v", "dim", "cell", "i", "j", "home", "foreign"]
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                own = own.reset_index(drop=True)
                mixed = (own["key"].to_numpy().astype(np.uint64) >> np.uint64(7)).astype(np.int64)
                for q, here, home in routes(own["v"].tolist(), int(dim)):
                    rows, blocks = parts[int(dim), q], members[int(dim), q]
                    at_home = here[home[here]]
                    for k in range(blocks):
                        yield own.iloc[at_home].assign(cell=q, i=mixed[at_home] % rows, j=k, home=True, foreign=False)[columns]
                    for k in range(rows):
                        yield own.iloc[here].assign(cell=q, i=k, j=mixed[here] % blocks, home=False, foreign=~home[here])[columns]

    def join(pdf):
        import pandas as pd

        a, b = pdf[pdf["home"]], pdf[~pdf["home"]]
        ka, na = a["key"].to_numpy(), a["n"].to_numpy()
        links, out = np.zeros(len(a), np.int64), []
        left = _unit(a["v"].tolist()) if len(a) else None
        step = max(16, 4_000_000 // max(1, len(a)))
        for k in range(0, len(b) if len(a) else 0, step):
            part = b.iloc[k : k + step]
            kb, foreign = part["key"].to_numpy(), part["foreign"].to_numpy()
            near = left @ _unit(part["v"].tolist()).T >= cosine
            near[ka[:, None] == kb[None, :]] = False
            links += near @ part["n"].to_numpy()
            back = near[:, foreign].T @ na
            some = np.flatnonzero(back)
            tree = forest(near)
            out.append(pd.DataFrame({"key": kb[foreign][some], "partner": kb[foreign][some], "links": back[some]}))
            out.append(pd.DataFrame({"key": [ka[i] for i, _ in tree], "partner": [kb[j] for _, j in tree], "links": np.zeros(len(tree), np.int64)}))
        out.append(pd.DataFrame({"key": ka[links > 0], "partner": ka[links > 0], "links": links[links > 0]}))
        return pd.concat(out).astype(np.int64)

    dealt = classes.select("key", "n", "v", "dim").mapInPandas(deal, T.StructType([*classes.select("key", "n", "v", "dim").schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("foreign", T.BooleanType())]))
    found = cut(dealt.groupBy("dim", "cell", "i", "j").applyInPandas(join, "key long, partner long, links long"))
    links = found.where("key = partner").groupBy("key").agg(F.sum("links").alias("links"))
    tied = components(found.where("key <> partner").select(F.col("key").alias("a"), F.col("partner").alias("b")))
    keyed = classes.select("key", "class_id", "n").join(tied.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    keyed = keyed.withColumn("component", F.coalesce("component", "key"))
    # Rows that share an id hold classes together too.
    named = marked.where("v is not null and vec_id is not null").select("vec_id", F.xxhash64("v").alias("key")).distinct()
    twice = named.groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")
    if not twice.isEmpty():
        more = named.join(twice.select("vec_id", "a"), "vec_id").select("a", F.col("key").alias("b")).where("a <> b")
        every = found.where("key <> partner").select(F.col("key").alias("a"), F.col("partner").alias("b")).union(more)
        keyed = keyed.drop("component").join(components(every).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = keyed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    keyed = keyed.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    out = marked.withColumn("key", F.xxhash64("v")).withColumn("key", F.when(F.col("v").isNotNull(), F.col("key"))).drop("v").join(keyed, "key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
