"""Pages as tables: groups, changes, renderings, articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel.diff import diff_segments
from ..kernel.html import article, group_edits, groups, render, rewrite_css, undo
from ..kernel.resources import best_candidate, resource_url
from ..kernel.rewrite import Catalogue
from .rewriting import EDITS, SEGMENTS


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("group_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("heading", T.BooleanType()), T.StructField("edits", EDITS)])))
def _groups(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else [{"group_no": k, "text": g.text, "heading": g.heading, "edits": [e._asdict() for e in group_edits(g)]} for k, g in enumerate(groups(h))] for h in html])


def page_groups(pages: DataFrame) -> DataFrame:
    """One row per paragraph: page_id, group_no, text, heading, edits."""
    return pages.select("page_id", F.explode(_groups("html")).alias("g")).select("page_id", "g.*")


RENDERED = T.StructType([T.StructField("html", T.StringType()), T.StructField("title", T.StringType()), T.StructField("changed", T.IntegerType())])


def rendered_pages(pages: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """page_id, html, title, changed."""

    @F.pandas_udf(RENDERED)
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([render(h or "", u or "", catalogue) for h, u in zip(html, url, strict=True)], columns=["html", "title", "changed"])

    return pages.select("page_id", run("html", "url").alias("r")).select("page_id", "r.*")


@F.pandas_udf(T.StringType())
def best_image(srcset: pd.Series) -> pd.Series:
    """The candidate of a responsive set that fits a readable page."""
    return srcset.map(lambda s: None if s is None else best_candidate(s))


@F.pandas_udf(T.StringType())
def resource(value: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else resource_url(v, b or "") for v, b in zip(value, base, strict=True)])


@F.pandas_udf(T.StringType())
def undone(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else undo(h))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))
def _article(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else [{"type": t, "text": x} for t, x in article(h)] for h in html])


def article_blocks(pages: DataFrame) -> DataFrame:
    """One row per block: page_id, pos, type, text."""
    return pages.select("page_id", F.posexplode(_article("html")).alias("pos", "b")).select("page_id", "pos", "b.*")


@F.pandas_udf(T.StringType())
def css(text: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else rewrite_css(t, b) for t, b in zip(text, base, strict=True)])


@F.pandas_udf(SEGMENTS)
def difference(before: pd.Series, after: pd.Series) -> pd.Series:
    """Segments of after against before; null if either is null."""
    return pd.Series([None if a is None or b is None else [s._asdict() for s in diff_segments(a, b)] for a, b in zip(before, after, strict=True)])
