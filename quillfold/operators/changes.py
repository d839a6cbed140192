"""Data changes as DataFrame transforms: each returns the table after the change."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns by name; those the rows lack become null."""
    missing = set(rows.columns) - set(table.columns)
    if missing:
        raise ValueError(f"unknown columns {sorted(missing)}")
    return table.unionByName(rows.select(*(F.col(c).cast(table.schema[c].dataType) for c in rows.columns)), allowMissingColumns=True).select(*table.columns)


def _keys(rows: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """The keys of changed rows, broadcast if a count proves them few and they are short."""
    keys = rows.select(key)
    size = F.octet_length(F.col(key).cast("string"))
    n, longest = keys.limit(most + 1).agg(F.count(F.lit(1)), F.max(size)).first()
    return F.broadcast(keys) if n <= most and n * (longest or 0) <= 16 << 20 else keys


def update(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace whole rows by key; a key that is not there changes nothing."""
    keys = _keys(rows, key)
    known = rows.join(table.select(key).join(keys, key, "left_semi"), key, "left_semi")
    return insert(table.join(keys, key, "left_anti").select(*table.columns), known)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return insert(table.join(_keys(rows, key), key, "left_anti").select(*table.columns), rows)


def upsert_counts(table: DataFrame, rows: DataFrame, key: str) -> tuple[int, int]:
    """``(inserted, updated)``."""
    n, hit = rows.count(), rows.join(table.select(key), key, "left_semi").count()
    return n - hit, hit


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Null and repeated ids are ignored."""
    return table.join(_keys(ids.where(F.col(key).isNotNull()), key), key, "left_anti").select(*table.columns)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """``condition`` as made by :mod:`quillfold.functions.compare`; null keeps the row."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def set_where(table: DataFrame, condition: Column, key: str, **values: Any) -> DataFrame:
    """Change the named fields only; the key cannot be set."""
    if key in values:
        raise ValueError(f"{key} cannot be changed")
    hit = F.coalesce(condition, F.lit(False))
    new = {c: F.when(hit, coerced(v, table.schema[c])).otherwise(F.col(c)) for c, v in values.items()}
    return table.select(*(new[c].alias(c) if c in new else F.col(c) for c in table.columns))


def coerced(value: Any, field: T.StructField) -> Column:
    """A value for a field; columns pass, fractions for whole numbers and forbidden nulls raise.

    Texts become dates, times and numbers where the field is one, and raise if they cannot.
    """
    if isinstance(value, Column):
        return value.cast(field.dataType)
    if value is None:
        if not field.nullable:
            raise ValueError(f"{field.name} must not be null")
        return F.lit(None).cast(field.dataType)
    if isinstance(field.dataType, T.IntegralType) and not isinstance(value, bool):
        try:
            whole = Decimal(str(value)) % 1 == 0
        except InvalidOperation:
            whole = False
        if not whole:
            raise ValueError(f"{value} is not a whole number for {field.name}")
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
        value = datetime.fromisoformat(value.strip())
    return F.lit(value).cast(field.dataType)


def overlay(table: DataFrame, pending: DataFrame, key: str, seq: str, deleted: str) -> DataFrame:
    """``table`` as a transaction sees it: the latest pending change of a key wins, deletions hide."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    latest = pending.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    kept = table.join(latest.select(key), key, "left_anti").select(*table.columns)
    return kept.unionByName(latest.where(~F.col(deleted)).select(*table.columns))
