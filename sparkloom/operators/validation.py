"""Acceptance of proposed rewrites: shape checks in the JVM, the word-by-word check in Python behind them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import INVARIANT, NUMBERS, QUOTES, STOPS, SYMBOLS, found
from ..kernel.rewrite import Catalogue, default
from ..kernel.validate import fits_template, quoted_text


def shape_checks(original: Column, rewritten: Column) -> dict[str, Column]:
    """Named boolean columns; all must hold."""
    ratio = F.length(rewritten) / F.greatest(F.length(original), F.lit(1))

    def same(pattern: str, of=lambda c: c) -> Column:
        return found(of(original), pattern) == found(of(rewritten), pattern)

    numbers = lambda c: F.transform(found(c, NUMBERS), lambda n: F.regexp_replace(n, r"[.,]$", ""))
    return {
        "not_empty": (rewritten != "") & ~rewritten.rlike(r"\n\s*\n"),
        "length_fits": ratio.between(0.6, 1.7),
        "numbers_kept": numbers(original) == numbers(rewritten),
        "words_kept": same(INVARIANT, F.lower),
        "symbols_kept": same(SYMBOLS),
        "quotes_kept": same(QUOTES),
        "stops_kept": same(STOPS),
    }


def accepts(original: Column, rewritten: Column, catalogue: Catalogue | None = None) -> Column:
    """Whether a rewrite passes all checks; false for nulls."""
    own = None if catalogue is None or catalogue is default() else catalogue

    @F.pandas_udf("boolean")
    def exact(before: pd.Series, after: pd.Series) -> pd.Series:
        of = own or default()
        return pd.Series([None if a is None or b is None else quoted_text(a) == quoted_text(b) and fits_template(a, b, of) for a, b in zip(before, after, strict=True)])

    shape = F.lit(True)
    for check in shape_checks(original, rewritten).values():
        shape = shape & check
    # Only pairs that pass the shape checks go to Python.
    return F.coalesce(shape & exact(F.when(shape, original), F.when(shape, rewritten)), F.lit(False))


def model_or_rules(model_out: Column, rules_out: Column, same_length: Column) -> Column:
    """The model's texts where they came back whole, else the rules'."""
    return F.when(same_length & model_out.isNotNull(), model_out).otherwise(rules_out)
