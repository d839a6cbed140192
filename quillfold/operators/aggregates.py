"""Aggregates with the reference rules: null adds 0, averages count every row, nothing gives 0."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum; 0 over no rows.  Doubles with cents are summed as decimals by the caller for exact results."""
    return F.coalesce(F.sum(x), F.lit(0))


def exact_total(x: Column, scale: int = 10) -> Column:
    """The sum as a double, added up as decimals of 28 digits before the point and ``scale`` after it.

    The result does not depend on the order of the rows.  Values of more places lose those beyond
    ``scale``; values and sums of more digits, NaN and infinity raise, as they do in a decimal sum.
    """
    return F.coalesce(F.sum(x.cast(f"decimal(38,{scale})")).cast("double"), F.lit(0.0))


def average(x: Column, scale: int = 10) -> Column:
    """Sum over the number of all rows, nulls included; 0 over no rows."""
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(exact_total(x, scale) / n)


def count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(F.coalesce(condition, F.lit(False)))


def group(df: DataFrame, keys: dict[str, Column | str], **aggregates: Column) -> DataFrame:
    """Group by named keys; null is a group.  Filter the result for a condition on groups."""
    columns = [(F.col(k) if isinstance(k, str) else k).alias(n) for n, k in keys.items()]
    return df.groupBy(*columns).agg(*(a.alias(n) for n, a in aggregates.items()))


def summarise(df: DataFrame, **aggregates: Column) -> DataFrame:
    return df.agg(*(a.alias(n) for n, a in aggregates.items()))


def distinct(df: DataFrame, *columns: Any) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()
