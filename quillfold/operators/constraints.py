"""Keys, references, declared schemas and identifiers, checked or made with DataFrame operations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConstraintError(ValueError):
    """Rows break a declared constraint."""


def duplicates(df: DataFrame, *columns: str, sparse: bool = False) -> DataFrame:
    """Key values that occur more than once, with their count ``n``; ``sparse`` skips null keys."""
    rows = df.dropna(how="any", subset=list(columns)) if sparse else df
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(df: DataFrame, foreign_key: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference is not in the target."""
    return df.where(F.col(foreign_key).isNotNull()).join(target.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti").select(*df.columns)


def require(df: DataFrame, message: str) -> None:
    """Raise if ``df`` (rows that break a constraint) is not empty."""
    rows = df.take(3)
    if rows:
        raise ConstraintError(f"{message}: {rows}")


def field(name: str, kind: str, *, required: bool = False, default: Any = None, key: bool = False, refers: str | None = None, label: str | None = None) -> T.StructField:
    """A declared field; everything besides the type is in the field's metadata."""
    facts = {"required": required, "key": key, "default": default, "refers": refers, "label": label}
    return T.StructField(name, T._parse_datatype_string(kind), not required, {k: v for k, v in facts.items() if v})


def violations(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows that lack a required field; ``strict`` also refuses unknown fields and other types."""
    if strict:
        known = {f.name: f.dataType for f in schema}
        wrong = [f.name for f in df.schema if f.name not in known or known[f.name] != f.dataType]
        if wrong:
            raise ConstraintError(f"unknown or wrongly typed fields {wrong}")
    needed = [f.name for f in schema if f.metadata.get("required")]
    absent = [n for n in needed if n not in df.columns]
    if absent:
        return df
    bad = F.lit(False)
    for n in needed:
        bad = bad | F.col(n).isNull()
    return df.where(bad)


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add fields that the rows lack: the declared default, else zero if required, else null."""
    zeros = {"string": "", "boolean": False}
    out = []
    for f in schema:
        value = f.metadata.get("default")
        if value is None and f.metadata.get("required"):
            value = zeros.get(f.dataType.simpleString(), 0)
        out.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(value).cast(f.dataType).alias(f.name))
    return df.select(*out, *(c for c in df.columns if c not in schema.names))


def ddl(name: str, schema: T.StructType) -> str:
    """The declared schema as text."""
    lines = []
    for f in schema:
        flags = [w for w, k in (("pk", "key"), ("required", "required")) if f.metadata.get(k)]
        flags += [f"default {f.metadata['default']!r}"] if "default" in f.metadata else []
        flags += [f"references {f.metadata['refers']}"] if "refers" in f.metadata else []
        lines.append(" ".join([f'  "{f.name}" "{f.dataType.simpleString()}"', *flags]))
    return f'create table "{name}" (\n' + ",\n".join(lines) + "\n);"


def numbered(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """New whole-number ids after the largest in ``table``, without a global sort.

    Rows are numbered within their partitions; partition sizes give each its first number.  ``rows``
    must give the same rows in the same partitions whenever it is run, as a stored table does: write a
    shuffled result first.
    """
    start = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, n = {}, int(start) + 1
    for r in sizes:
        offsets[r["p"]], n = n, n + r["n"]
    table_of = F.create_map(*(F.lit(v) for kv in offsets.items() for v in kv)) if offsets else None
    new = (F.element_at(table_of, part) + place if offsets else F.lit(0)).cast(table.schema[key].dataType)
    return placed.withColumn(key, new).drop("_at")


def random_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(key, F.expr("uuid()"))


def ordered_ids(rows: DataFrame, key: str) -> DataFrame:
    """Random ids of version 7: the first 48 bits are the time in milliseconds, so ids order by it."""
    time = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.expr("uuid()")
    return rows.withColumn(key, F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(rest, 16, 21)))


def object_ids(rows: DataFrame, key: str) -> DataFrame:
    """24 hexadecimal digits that begin with the time, so that ids order by it."""
    seconds = F.lpad(F.lower(F.hex(F.unix_timestamp())), 8, "0")
    return rows.withColumn(key, F.concat(seconds, F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 16)))
