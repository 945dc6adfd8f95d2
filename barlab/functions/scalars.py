"""Column functions that statistics and execution share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_slippage(price: Column, direction: Column, bps: float) -> Column:
    return price * (1 + direction * bps / 10000.0)


def metric_safe_reason(reason: Column) -> Column:
    """Snake case: runs of other characters become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(reason)), "[^0-9a-zA-Z]+", "_"), F.lit("_"))


def return_as_decimal(pct: Column) -> Column:
    return F.coalesce(pct, F.lit(0.0)) / 100


def ratio_or_zero(x: Column, y: Column) -> Column:
    """x / y, or 0 where y is null or not positive."""
    return F.coalesce(x / F.when(y > 0, y), F.lit(0.0))


def risk_fraction(risk_per_share: Column, entry_price: Column) -> Column:
    """risk / price, or 0 where either is null or not positive."""
    return ratio_or_zero(F.when(risk_per_share > 0, risk_per_share), entry_price)
