"""Numbers as text and small number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(x: Column) -> Column:
    # Six decimals in plain notation, then trailing zeros away: "40.6", "25.", "0.0001".
    text = x.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(text, "0+$", "")


def float_text(x: Column) -> Column:
    """``40.6`` and ``25.0``: a whole number keeps one decimal."""
    text = _plain(x)
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def short_text(x: Column) -> Column:
    """``40.6`` and ``25``: a whole number has no decimals."""
    return F.regexp_replace(_plain(x), "\\.$", "")


def out_of_range(value: Column, lower: Column, upper: Column) -> Column:
    """True when the value lies outside [lower, upper]; false unless all three are known."""
    return F.coalesce((value < lower) | (value > upper), F.lit(False)) & (
        value.isNotNull() & lower.isNotNull() & upper.isNotNull()
    )


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; null for an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 2)
