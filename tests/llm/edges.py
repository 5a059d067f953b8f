"""Rows that every operator on documents has to take."""

from pyspark.sql import types as T

LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ROWS = [
    (0, "the quick brown fox jumps over the lazy dog"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, LONG), (7, LONG), (8, "the quick brown fox jumps over the lazy dog"),
    (9, "ünïcode ß 数字 🎉     end"), (9, "ünïcode ß 数字 🎉     end"), (10, "123 456 --- !!!"), (None, "a null id"), (11, "x" * 50_000), (12, "<|endoftext|> is text"),
    (13, "a\0b nul\0 \0"), (14, " " * 1_000_000 + "a"), (15, "é" * 1_000_000), (16, "\n" * 1000 + "<|endoftext|>"),
]
#: Names that operators use themselves.
EXTRA = ("score", "key", "size", "start", "bucket", "row", "length", "component", "node", "n", "block", "law", "slot", "token", "label", "part", "rank", "toxic", "accepted")


def documents(spark, rows=ROWS, extra=EXTRA):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in extra]])
    langs, sources = ["en", "fr", None], ["a", None, "b", "ä"]
    data = [(i, t, langs[k % 3], sources[k % 4], len(t or ""), *["clash"] * len(extra)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def ids(rows=ROWS):
    return sorted((-1 if i is None else i) for i, _ in rows)


def got_ids(found):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in found)
