"""Scalar expressions shared by reports and readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_p(p: Column, limit: float = 0.01, digits: int = 2) -> Column:
    """A p-value with small ones folded; n/a if it is missing."""
    shown = F.format_string(f"%.{digits}f", p)
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < limit, F.lit(f"$<${limit:g}")).otherwise(shown)


def tex_escape(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("\\_"))


def bold_if(test: Column, text: Column) -> Column:
    return F.when(test, F.concat(F.lit("\\textbf{"), text, F.lit("}"))).otherwise(text)


def half_even(value: Column) -> Column:
    """The nearest integer, halves to the even one."""
    return F.rint(value).cast("long")


def floor_div(value: Column, by: int) -> Column:
    """Integer division towards minus infinity."""
    return F.floor(value / F.lit(by)).cast("long")


def at_least(value: Column, least: float) -> Column:
    return F.greatest(value, F.lit(least))


def finite_or(value: Column, default: float = 0.0) -> Column:
    """A number that is neither NaN nor infinite, or the default; null counts as NaN."""
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), value).otherwise(F.lit(default))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
