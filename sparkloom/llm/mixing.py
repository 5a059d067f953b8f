"""Mixing sources to target weights: fixed blocks of words, multinomial source counts per output shard, index permutations.

Each source's documents form one stream of words, cut into blocks of a fixed length. The mix is a list
of block slots, dealt to output shards of equal size:

1. Every slot of a shard draws its source by the target weights, which makes a shard's source counts
   multinomial.
2. Where the shards together draw a source more often than its budget of slots, the draws over it, of
   every shard in proportion, go to sources that were drawn too seldom, dealt by a permutation. So
   each source meets its target to within a block and few draws are changed: of n slots some
   sqrt(n) for each source.
3. The counts number a source's slots through all shards. Slot j maps through the source's
   pseudorandom permutation of pass j // blocks to a block index, and blocks join by (source, index).
   No block comes again before all of its source have come.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, WORD, cut, join_small, placed

#: Slots of a source and shard are made in runs of so many rows; tasks that make slots or draws make about DRAWS of them.
RUN, DRAWS = 1 << 14, 1 << 18


def shuffled_index(df: DataFrame, index: str, size: str, out: str, key: list[Column], rounds: int = 14) -> DataFrame:
    """Adds out, a keyed pseudorandom permutation of 0..size-1 at index (a swap-or-not shuffle: a permutation for any size)."""
    df = df.withColumn(out, F.col(index))
    for r in range(rounds):
        shift = F.pmod(F.xxhash64(F.lit(2 * r), *key), F.col(size))
        df = df.withColumn("_other", F.pmod(shift - F.col(out), F.col(size)))
        coin = F.xxhash64(F.lit(2 * r + 1), *key, F.greatest(F.col(out), F.col("_other"))).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(out, F.when(coin, F.col("_other")).otherwise(F.col(out)))
    # A filter that Catalyst infers on the result would be pushed down through all rounds, each of which
    # repeats the one before; it stops at a generator.
    return df.drop("_other").withColumn(out, F.explode(F.array(out)))


def in_intervals(points: DataFrame, at: str, intervals: DataFrame, total: int) -> DataFrame:
    """Joins points with the interval [low, high) that their column at lies in; intervals are disjoint and fill 0..total.

    The range is cut into cells, some four for each interval, and cells join by number.
    """
    n = max(1, intervals.count())
    width = max(1, total // (4 * n))
    cells = intervals.where("low < high").withColumn("_cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    cells = F.broadcast(cells) if 6 * n <= SMALL_ROWS else cells
    got = points.withColumn("_cell", F.expr(f"{at} div {width}")).join(cells, "_cell")
    return got.where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).drop("_cell", "low", "high")


def before(order: str, value: str, *group: str) -> Column:
    """The sum of value over the rows before, within group."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")


def source_plan(sized: DataFrame, cycle: tuple[int, ...], repeats: int, block: int) -> DataFrame:
    """One row per source: source_no, source, source_size, target, blocks, slots, first_slot, all_slots.

    Targets share the sum of all sizes by weight and stop at repeats times the source's size; what is
    over is shared anew by weight. With sources ordered by cap / weight that is the first level
    (rest / weights left) which no later source's cap lies under. The table has a row for each
    source, which is the size of the mix's own settings.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("source_no") % len(cycle) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("order", F.row_number().over(by_cap)).withColumn("level", (F.col("total") - capped) / left)
    ends = F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("order", "level"))
    s = s.withColumn("share", F.min(ends).over(whole)["level"])
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("share")), F.col("cap")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    mean = F.col("source_size") / F.col("blocks")
    s = s.withColumn("slots", F.when(F.col("blocks") > 0, F.least(F.round(F.col("target") / mean).cast("long"), F.col("blocks") * repeats)).otherwise(F.lit(0).cast("long")))
    s = s.withColumn("first_slot", F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return s.select("source_no", "source", "source_size", "target", "blocks", "slots", "first_slot", F.sum("slots").over(whole).alias("all_slots"))


def row_hashes(documents: DataFrame) -> list[Column]:
    """Two hashes, of 64 and 32 bits, of a row's columns together; rows that are equal share them."""
    columns = [F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in documents.dtypes]
    present = [F.col(f"`{c}`").isNull() for c in documents.columns]
    return [F.xxhash64(*columns, *present).alias("rid"), F.hash(*columns).alias("rid2")]


class Mix:
    """A mix of documents.

    plan: see source_plan. rows: one per document row with source_no, doc_id, size, rid and rid2 (hashes
    of the row) and start, its place in the source's stream. A null source is a source, a null text has
    no words, equal rows are separate documents, a null id is an id. Other columns only tell rows apart.
    An empty table gives an empty mix.
    """

    def __init__(self, documents: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3), repeats: int = 3, block: int = 64, shards: int = 64, seed: int = 10):
        self.spark, self.block, self.shards, self.seed = documents.sparkSession, block, shards, seed
        words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
        sized = cut(documents.select("doc_id", "source", words.alias("size"), *row_hashes(documents)))
        self.plan = cut(source_plan(sized, cycle, repeats, block))
        keys = self.plan.select("source_no", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias("_source"))
        rows = sized.withColumn("_source", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")))
        rows = join_small(rows, keys, "_source").drop("_source")
        self.rows = placed(rows, ["source_no"], ["doc_id", "rid", "rid2", "size"], F.col("size"), "start")
        first = self.plan.select("all_slots").first()
        self.size = int(first[0]) if first else 0

    @functools.cached_property
    def drawn(self) -> DataFrame:
        """(shard, source_no, n): how often the slots of each shard drew each source. Shards differ by one slot at most."""
        slots = self.spark.range(0, self.size, 1, max(1, -(-self.size // DRAWS))).select((F.col("id") % self.shards).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(self.seed), F.lit("draw"), "id"), F.lit(max(1, self.size))).alias("_u"))
        sources = self.plan.select("source_no", F.col("first_slot").alias("low"), (F.col("first_slot") + F.col("slots")).alias("high"))
        return cut(in_intervals(slots, "_u", sources, self.size).groupBy("shard", "source_no").agg(F.count("*").alias("n")))

    @functools.cached_property
    def counts(self) -> DataFrame:
        """(shard, source_no, n): the drawn counts with each source's total brought to its budget."""
        total = self.drawn.groupBy("source_no").agg(F.sum("n").alias("total"))
        budget = cut(self.plan.select("source_no", "slots").join(total, "source_no", "left").select("source_no", "slots", F.coalesce("total", F.lit(0).cast("long")).alias("total")))
        changed = budget.agg(F.sum(F.greatest(F.col("total") - F.col("slots"), F.lit(0)))).first()[0] or 0
        if not changed:
            return self.drawn
        over = self.drawn.join(budget.where("total > slots"), "source_no").withColumn("_before", before("shard", "n", "source_no"))

        def share(upto: Column) -> Column:  # of the draws up to there, how many are over
            return F.floor(upto.cast("decimal(38,0)") * (F.col("total") - F.col("slots")).cast("decimal(18,0)") / F.col("total")).cast("long")

        taken = cut(over.select("shard", "source_no", (share(F.col("_before") + F.col("n")) - share(F.col("_before"))).alias("n")).where("n > 0"))
        freed = taken.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("low", before("shard", "n"))
        wanting = budget.where("total < slots").select("source_no", (F.col("slots") - F.col("total")).alias("n")).withColumn("low", before("source_no", "n"))
        places = self.spark.range(0, changed, 1, max(1, -(-changed // DRAWS))).withColumn("_size", F.lit(changed).cast("long"))
        places = shuffled_index(places, "id", "_size", "_to", [F.lit(self.seed), F.lit("over")])
        dealt = in_intervals(places, "id", cut(freed.select("shard", "low", (F.col("low") + F.col("n")).alias("high"))), changed)
        dealt = in_intervals(dealt, "_to", cut(wanting.select("source_no", "low", (F.col("low") + F.col("n")).alias("high"))), changed)
        change = taken.select("shard", "source_no", (-F.col("n")).alias("n")).union(dealt.groupBy("shard", "source_no").agg(F.count("*").alias("n")))
        return cut(self.drawn.union(change).groupBy("shard", "source_no").agg(F.sum("n").alias("n")).where("n > 0"))

    def _numbered(self) -> DataFrame:
        """Every slot: shard, source_no, block, and _place, its place in the shard before sources are mixed up."""
        counts = self.counts.withColumn("_first", before("shard", "n", "source_no")).withColumn("_low", before("source_no", "n", "shard"))
        counts = join_small(counts, self.plan.select("source_no", "blocks"), "source_no")
        runs = counts.withColumn("_run", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})")))
        runs = runs.repartition(max(self.spark.sparkContext.defaultParallelism, -(-self.size // DRAWS)), "source_no", "shard", "_run")
        each = runs.withColumn("_i", F.explode(F.expr(f"sequence(_run * {RUN}, least(n, (_run + 1) * {RUN}) - 1)")))
        each = each.select("shard", "source_no", "blocks", (F.col("_low") + F.col("_i")).alias("_place"), (F.col("_first") + F.col("_i")).alias("_j"))
        each = each.withColumn("_pass", F.expr("_j div blocks")).withColumn("_at", F.expr("_j % blocks"))
        return shuffled_index(each, "_at", "blocks", "block", [F.lit(self.seed), F.col("source_no"), F.col("_pass")])

    def slots(self) -> DataFrame:
        """Every slot of the mix: shard, slot (its place in the shard), source_no, block."""
        rest, whole = self.size % self.shards, self.size // self.shards
        each = self._numbered().withColumn("_size", F.lit(whole).cast("long") + (F.col("shard") < rest).cast("long"))
        return shuffled_index(each, "_place", "_size", "slot", [F.lit(self.seed), F.lit("slot"), F.col("shard")]).select("shard", "slot", "source_no", "block")

    def pieces(self) -> DataFrame:
        """Each document's part in each block, [from_word, to_word) of its words; a document without words has one row with null block."""
        b = self.block
        at = self.rows.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(start div {b}, (start + size - 1) div {b}), null)")))
        return at.withColumn("from_word", F.greatest(F.col("block") * b, F.col("start")) - F.col("start")).withColumn("to_word", F.least((F.col("block") + 1) * b, F.col("start") + F.col("size")) - F.col("start"))

    def mixture(self) -> DataFrame:
        """The mix itself: shard, slot, doc_id, source_no, block, from_word, to_word; blocks joined by index."""
        return self.slots().hint("merge").join(self.pieces().where("block is not null"), ["source_no", "block"]).select("shard", "slot", "doc_id", "source_no", "block", "from_word", "to_word")

    def counted(self) -> DataFrame:
        """pieces() joined by index with what the slots take of each block: times (0 at least) and first_shard, the least shard with it."""
        times = self._numbered().groupBy("source_no", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
        # Spark takes the slots for as few as the sources they come from; without the hint it would broadcast them.
        return self.pieces().join(times.hint("merge"), ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))

    def taken(self) -> DataFrame:
        """One row per document row: doc_id, size, source_size, target, taken, first_shard (the least shard with words of it; null of none)."""
        words = F.sum((F.col("to_word") - F.col("from_word")) * F.col("times"))
        got = self.counted().where("block is not null").groupBy("source_no", "start", "doc_id", "size").agg(words.cast("long").alias("taken"), F.min("first_shard").alias("first_shard"))
        none = self.rows.where("size = 0").select("source_no", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("int").alias("first_shard"))
        got = join_small(got.unionByName(none), self.plan.select("source_no", "source_size", "target"), "source_no")
        return got.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mixed_documents(documents: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them, with the columns of documents, whatever these are called.

    A document whose blocks are taken up to n times gives up to n rows: row r has the words of those
    of its blocks that are taken r times or more. Where that is all of them it has the whole text,
    else these words joined by spaces. Documents that the mix does not take are gone, those without
    words among them. Equal rows are separate documents. No rows give no rows.
    """
    mix = Mix(documents, **settings)
    spans = F.array_sort(F.collect_list(F.struct("from_word", "to_word", "times")))
    each = mix.counted().where("block is not null").groupBy("source_no", "start", "rid", "rid2").agg(spans.alias("_spans"), F.max("times").alias("_most")).where("_most > 0")
    each = each.select("rid", "rid2", F.expr("transform(sequence(1L, _most), r -> named_struct('r', r, 'whole', forall(_spans, s -> s.times >= r), 'spans', filter(_spans, s -> s.times >= r)))").alias("_copies"))
    # Rows that are equal are one here; as many as there are come back from the other side.
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), *row_hashes(documents)).groupBy("rid", "rid2").agg(F.first("_row").alias("_row"))
    got = whole.join(each.hint("merge"), ["rid", "rid2"]).select("_row", F.explode("_copies").alias("_copy"))
    got = got.withColumn("_words", F.expr(f"if(_copy.whole, null, regexp_extract_all(_row.text, '{WORD}', 0))".replace("\\", "\\\\")))
    part = F.expr("array_join(flatten(transform(_copy.spans, s -> slice(_words, cast(s.from_word + 1 as int), cast(s.to_word - s.from_word as int)))), ' ')")
    got = got.withColumn("_text", F.when(F.col("_copy.whole"), F.col("_row.text")).otherwise(part))
    kinds = dict(documents.dtypes)
    return got.select(*[F.col("_text").alias("text") if c == "text" else F.length("_text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c) for c in documents.columns])
