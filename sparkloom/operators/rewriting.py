"""The kernel over columns: segments, text and edits, behind a filter in the JVM.

Catalyst cannot derive a filter from a Python function. Texts in which no required word of any rule
stands, and for segments no quotation mark and no person's role either, are given to Python as nulls
and come back as they are by a JVM expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel.diff import diff_segments
from ..kernel.lexicon import ABOUT
from ..kernel.rewrite import Catalogue, default
from ..kernel.rules import rules_from_rows

# Types, not DDL strings, so that this module can be imported before there is a session.
SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("original", T.StringType()), T.StructField("protected", T.BooleanType())]))
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("original", T.StringType())]))
#: What may make a protected segment.
MARKS = r"[\"'“‘«„]|(?i:politician|model|agent|assistant)"


def catalogue_of(rules: DataFrame | None) -> Catalogue:
    """The catalogue of a table (rule_id, phrase, replacement, context, unless); a catalogue is small by nature, so it is collected."""
    if rules is None:
        return default()
    return Catalogue(rules_from_rows(r.asDict() for r in rules.orderBy("rule_id").collect()))


def _trie(words: list[str]) -> str:
    """A regular expression of words that tries each common beginning once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + _trie(rest) if h else "" for h, rest in sorted(heads.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _whole(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?i)(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])")


def may_change(c: Column, catalogue: Catalogue) -> Column:
    """True of every text that a rule changes; no stricter than the kernel.

    Rules of everyday words need a word of software too, so that "lie" alone sends no text to Python.
    """
    words, free = catalogue.required_words(), catalogue.free_words()
    if not words:
        return F.lit(True)
    tied = sorted(set(words) - set(free))
    out = _whole(c, _trie(free)) if free else F.lit(False)
    return out | (_whole(c, ABOUT.pattern.replace(r"\b", "")) & _whole(c, _trie(tied))) if tied else out


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores; inputs of many partitions are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _catalogue(catalogue: Catalogue) -> Catalogue | None:
    return None if catalogue is default() else catalogue


def edits(c: Column, catalogue: Catalogue | None = None, heading: Column | None = None, prefilter: bool = True) -> Column:
    """Changes of a text with code-point offsets into the original; null for a null text."""
    catalogue = catalogue or default()
    own = _catalogue(catalogue)

    @F.pandas_udf(EDITS)
    def run(texts: pd.Series, headings: pd.Series) -> pd.Series:
        of = own or default()
        return pd.Series([None if t is None else [e._asdict() for e in of.edits(t, bool(h))[0]] for t, h in zip(texts, headings, strict=True)])

    heading = F.lit(False) if heading is None else heading
    given = F.when(may_change(c, catalogue), c) if prefilter else c
    return F.when(c.isNotNull(), F.coalesce(run(given, heading), F.array().cast(EDITS)))


def segments(c: Column, catalogue: Catalogue | None = None, prefilter: bool = True) -> Column:
    """A text in pieces with originals of changed ones; null for a null text."""
    catalogue = catalogue or default()
    own = _catalogue(catalogue)

    @F.pandas_udf(SEGMENTS)
    def run(texts: pd.Series) -> pd.Series:
        of = own or default()
        return pd.Series([None if t is None else [s._asdict() for s in of.segments(t)] for t in texts])

    given = F.when(may_change(c, catalogue) | c.rlike(MARKS), c) if prefilter else c
    whole = F.when(c != "", F.array(F.struct(c.alias("text"), F.lit(None).cast("string").alias("original"), F.lit(False).alias("protected")))).otherwise(F.array().cast(SEGMENTS))
    return F.when(c.isNotNull(), F.coalesce(run(given), whole))


def text_of(segments_: Column) -> Column:
    return F.array_join(F.transform(segments_, lambda s: s["text"]), "")


def original_of(segments_: Column) -> Column:
    return F.array_join(F.transform(segments_, lambda s: F.coalesce(s["original"], s["text"])), "")


def changed(segments_: Column) -> Column:
    return F.exists(segments_, lambda s: s["original"].isNotNull())


def apply_edits(c: Column, edits_: Column) -> Column:
    """The text with edits applied, without Python: what is kept before each edit, the edit, and the rest."""
    n = F.size(edits_)
    before = F.transform(edits_, lambda e, k: F.substr(c, F.when(k == 0, F.lit(0)).otherwise(F.get(edits_, k - 1)["end"]) + 1, e["start"] - F.when(k == 0, F.lit(0)).otherwise(F.get(edits_, k - 1)["end"])))
    parts = F.array_join(F.transform(F.arrays_zip(before.alias("before"), edits_.alias("edit")), lambda x: F.concat(x["before"], x["edit"]["text"])), "")
    return F.when(n == 0, c).otherwise(F.concat(parts, F.substr(c, F.get(edits_, n - 1)["end"] + 1)))


def undo_edits(rewritten: Column, edits_: Column) -> Column:
    """The original of a rewritten text: applies the edits the other way round."""
    moved = F.transform(
        edits_, lambda e, k: F.struct((e["start"] + _shift(edits_, k)).alias("start"), (e["start"] + _shift(edits_, k) + F.length(e["text"])).alias("end"), e["original"].alias("text"), e["text"].alias("original"))
    )
    return apply_edits(rewritten, moved)


def _shift(edits_: Column, k: Column) -> Column:
    return F.aggregate(F.slice(edits_, F.lit(1), k), F.lit(0), lambda acc, e: acc + F.length(e["text"]) - (e["end"] - e["start"]))


def rewrite_blocks(blocks: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """Adds original, edits and the rewritten text to rows with text and, perhaps, type; quotes pass as they are."""
    blocks = spread(blocks)
    quote = F.col("type") == "quote" if "type" in blocks.columns else F.lit(False)
    heading = F.col("type") == "heading" if "type" in blocks.columns else None
    out = blocks.withColumn("original", F.col("text")).withColumn("edits", edits(F.when(~quote, F.col("text")), catalogue, heading))
    out = out.withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))
    return out.withColumn("text", apply_edits(F.col("original"), F.col("edits")))


def edit_table(rewritten: DataFrame, keys: list[str]) -> DataFrame:
    """One row per change: keys, edit_no, start, end, text, original."""
    return rewritten.select(*keys, F.posexplode("edits").alias("edit_no", "e")).select(*keys, "edit_no", "e.start", "e.end", "e.text", "e.original")


def register(spark, rules: DataFrame | None = None) -> None:
    """SQL functions rewrite_edits, rewrite_segments, rewrite_text, has_alarm, diff_segments and accept_rewrite (of two texts each)."""
    own = _catalogue(catalogue_of(rules))

    def udf(name, kind, f):
        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            of = own or default()
            return pd.Series([None if t is None else f(of, t) for t in texts])

        spark.udf.register(name, run)

    udf("rewrite_edits", EDITS, lambda of, t: [e._asdict() for e in of.edits(t)[0]])
    udf("rewrite_segments", SEGMENTS, lambda of, t: [s._asdict() for s in of.segments(t)])
    udf("rewrite_text", "string", lambda of, t: of.rewrite(t))
    udf("has_alarm", "boolean", lambda of, t: of.changes(t))

    @F.pandas_udf(SEGMENTS)
    def difference(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else [x._asdict() for x in diff_segments(a, b)] for a, b in zip(before, after, strict=True)])

    @F.pandas_udf("boolean")
    def accepted(before: pd.Series, after: pd.Series) -> pd.Series:
        from ..kernel.validate import accepts

        of = own or default()
        return pd.Series([False if a is None or b is None else accepts(a, b, of) for a, b in zip(before, after, strict=True)])

    spark.udf.register("diff_segments", difference)
    spark.udf.register("accept_rewrite", accepted)
