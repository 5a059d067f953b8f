"""What goes to a model and what comes back, around any model: choice of items, messages, and the rules' pass over accepted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rewriting, validation
from .intervals import budget_split, first_n

#: Groups of a page that are given to a model, and the lengths of those worth it.
MOST_ITEMS, SHORTEST, LONGEST = 60, 20, 2000
#: Characters at the beginning of an article that a model on a server is given.
MOST_HEAD = 60_000


def items(rewritten: DataFrame, key: str, pos: str, most: int = MOST_ITEMS) -> DataFrame:
    """The rows (original, text, perhaps type) of each key that a model should see: no quotes, of fitting length, changed by rules or about AI and alarm; the first `most` in order."""
    quote = F.col("type") == "quote" if "type" in rewritten.columns else F.lit(False)
    fits = F.length("original").between(SHORTEST, LONGEST) & tx.needs_model(F.col("original"), F.col("text")) & ~quote
    return first_n(rewritten.where(fits), key, pos, most)


def messages(system: str, examples: list[tuple[str, str]], paragraph: Column) -> Column:
    """A chat as an array of (role, content): instructions, each example with its answer, the paragraph."""
    said = [("system", F.lit(system))]
    for asked, answered in examples:
        said += [("user", F.lit(asked)), ("assistant", F.lit(answered))]
    said.append(("user", paragraph))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said])


def head_and_tail(rows: DataFrame, key: str, pos: str, length: str, head, tail, most: int = MOST_HEAD) -> DataFrame:
    """Rows of each key's head, up to most characters, as head gives them, and the others as tail does, in one table."""
    split = budget_split(rows, key, pos, length, most)
    return head(split.where("in_head").drop("in_head")).unionByName(tail(split.where("not in_head").drop("in_head")))


def after_model(rows: DataFrame, original: str, answer: str, rules_text: str, out: str) -> DataFrame:
    """Adds out: the model's answer, cleaned and with the rules run over it, where it is accepted; else the rules' text."""
    rows = rows.withColumn("_clean", tx.clean_model_output(F.col(answer), F.col(original)))
    rows = rows.withColumn("_fine", validation.accepts(F.col(original), F.col("_clean")))
    rows = rows.withColumn("_edits", rewriting.edits(F.when(F.col("_fine"), F.col("_clean"))))
    return rows.withColumn(out, F.when(F.col("_fine"), rewriting.apply_edits(F.col("_clean"), F.col("_edits"))).otherwise(F.col(rules_text))).drop("_clean", "_fine", "_edits")


def distinct_in_order(rows: DataFrame, key: str, value: str, pos: str, out: str) -> DataFrame:
    """Each key's distinct values as an array, by where they came first; values are combined before the shuffle."""
    first = rows.groupBy(key, value).agg(F.min(pos).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", value)))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x[value]).alias(out))
