"""Named collections of documents: Parquet folders, one per version, and changes with checks.

A collection is a folder of version folders.  New rows are appended to the newest version.  Any other
change, or a chain of changes, is a DataFrame over that version, written as the next one; a version
counts once Spark's ``_SUCCESS`` file is in it, so nothing is overwritten while it is read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfold.operators import changes, constraints, rows


class Store:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    def _fs(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _children(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def names(self, system: bool = False) -> list[str]:
        return [n for n in self._children(self.path) if system or not n.startswith("__")]

    def exists(self, name: str) -> bool:
        return name in self.names(system=True)

    def drop(self, name: str) -> None:
        self._writable()
        fs, where = self._fs(f"{self.path}/{name}")
        fs.delete(where, True)

    def collection(self, name: str, key: str, schema: T.StructType | None = None, **rules: Any) -> Collection:
        return Collection(self, name, key, schema, **rules)

    def sql(self, query: str, **parameters: Any) -> DataFrame:
        """A Spark SQL query over all collections as views, with ``:name`` parameters."""
        for n in self._readable():
            self._newest(n).createOrReplaceTempView(n)
        return self.spark.sql(query, args=parameters)

    def copy_to(self, path: str) -> Store:
        """The newest version of every collection, in another folder."""
        target = Store(self.spark, path)
        for n in self._readable():
            self._newest(n).write.mode("error").parquet(f"{target.path}/{n}/v00000001")
        return target

    def statistics(self) -> DataFrame:
        """Versions and rows of every collection, counted in one job."""
        names = self.names()
        known = self.spark.createDataFrame([(n, len(self.versions(n))) for n in names], "name string, versions int")
        counts = known.select("name", F.lit(0).cast("long").alias("rows"))
        for n in self._readable():
            counts = counts.unionByName(self._newest(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows"))
        return known.join(counts.groupBy("name").agg(F.sum("rows").alias("rows")), "name")

    def _readable(self) -> list[str]:
        """Collections that have a complete version."""
        return [n for n in self.names() if self.versions(n)]

    def _newest(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{self.versions(name)[-1]}")

    def versions(self, name: str) -> list[str]:
        base = f"{self.path}/{name}"
        return [v for v in self._children(base) if v.startswith("v") and "_SUCCESS" in self._children(f"{base}/{v}")]

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")


class Collection:
    """One collection.

    ``unique`` lists further unique keys and ``sparse`` those whose rows with a null do not count;
    ``references`` maps fields to collections.  ``layout`` sorts files by fields that are often
    filtered on, so that the reader skips row groups; it never changes results.
    """

    def __init__(
        self,
        store: Store,
        name: str,
        key: str,
        schema: T.StructType | None = None,
        *,
        unique: list[list[str]] | None = None,
        sparse: list[list[str]] | None = None,
        references: dict[str, Collection] | None = None,
        layout: list[str] | None = None,
        strict: bool = False,
    ) -> None:
        self.store, self.name, self.key, self.schema = store, name, key, schema
        self.unique, self.sparse, self.references = unique or [], sparse or [], references or {}
        self.layout, self.strict = layout or [], strict

    # reading
    def version(self) -> str | None:
        return next(reversed(self.store.versions(self.name)), None)

    def find_all(self) -> DataFrame:
        v = self.version()
        if v is None:
            if self.schema is None:
                raise LookupError(f"collection {self.name} is empty and has no schema")
            return self.store.spark.createDataFrame([], self.schema)
        df = self.store.spark.read.parquet(f"{self.store.path}/{self.name}/{v}")
        return constraints.with_defaults(df, self.schema) if self.schema else df

    def find(self, condition: Column | str, skip: int | None = None, limit: int | None = None) -> DataFrame:
        """``condition`` is a column, or a Spark SQL expression in a string."""
        return rows.find(self.find_all(), condition, skip, limit, self.key)

    def find_page(self, condition: Column | str, order: list[str], skip: int, take: int) -> tuple[DataFrame, int]:
        hits = self.find_all().where(condition)
        return rows.page(hits, order, skip, take, self.key), hits.count()

    def find_by_id(self, value: Any) -> Row | None:
        return next(iter(rows.find_by_id(self.find_all(), self.key, value).take(1)), None)

    def find_one(self, condition: Column | str) -> Row | None:
        return next(iter(self.find_all().where(condition).take(1)), None)

    def count(self, condition: Column | str | None = None) -> int:
        df = self.find_all()
        return (df if condition is None else df.where(condition)).count()

    def exists(self, condition: Column | str) -> bool:
        return self.find_one(condition) is not None

    def include(self, foreign_key: str, name: str, condition: Column | str | None = None, order: list[str] | None = None, skip: int = 0, take: int | None = None) -> DataFrame:
        """References loaded into ``name``, of all rows or of those of a condition or a page."""
        table, target = self.find_all(), self.references[foreign_key]
        found = table if condition is None else table.where(condition)
        if order is not None or skip or take is not None:
            found = rows.page(found, order or [], skip, take, self.key)
        return rows.include(found, foreign_key, target.find_all(), target.key, name)

    def sql(self, query: str, **parameters: Any) -> DataFrame:
        """A Spark SQL query in which this collection is the view of its name, with ``:name`` parameters."""
        self.find_all().createOrReplaceTempView(self.name)
        return self.store.spark.sql(query, args=parameters)

    # changing
    def insert(self, new: DataFrame) -> None:
        """Append rows; fields that ``new`` lacks get their declared defaults.

        Only the new rows are checked, against themselves and by joins with the stored ones.
        """
        new = constraints.with_defaults(new, self.schema) if self.schema else new
        if self.version() is None:
            self.commit(changes.insert(self._current(new), new))
            return
        self.store._writable()
        old = self.find_all()
        new = changes.insert(old.limit(0), new)
        self.check(new)
        for columns in ([self.key], *self.unique, *self.sparse):
            mine = new.dropna(how="any", subset=columns) if columns in self.sparse else new
            there = old.select(*(F.col(k).alias(f"_old_{k}") for k in columns))
            same = rows.all_of(*(mine[k].eqNullSafe(there[f"_old_{k}"]) for k in columns))
            constraints.require(mine.join(there, same, "left_semi"), f"duplicate {columns} in {self.name}")
        self._sorted(new).write.mode("append").parquet(f"{self.store.path}/{self.name}/{self.version()}")

    def update(self, new: DataFrame) -> int:
        table = self.find_all()
        n = new.join(table.select(self.key), self.key, "left_semi").count()
        self.commit(changes.update(table, new, self.key))
        return n

    def upsert(self, new: DataFrame) -> tuple[int, int]:
        table = self._current(new)
        counts = changes.upsert_counts(table, new, self.key)
        self.commit(changes.upsert(table, new, self.key))
        return counts

    def delete(self, ids: list[Any]) -> int:
        table = self.find_all()
        known = [i for i in dict.fromkeys(ids) if i is not None]
        gone = rows.find_by_ids(table, self.key, known)
        n = gone.count()
        self.commit(changes.delete(table, gone, self.key), checked=True)
        return n

    def delete_where(self, condition: Column) -> int:
        table = self.find_all()
        gone = table.where(condition).count()
        self.commit(changes.delete_where(table, condition), checked=True)
        return gone

    def set_where(self, condition: Column, **values: Any) -> int:
        table = self.find_all()
        n = table.where(condition).count()
        self.commit(changes.set_where(table, condition, self.key, **values))
        return n

    def apply(self, *steps: Callable[[DataFrame], DataFrame]) -> str:
        """A chain of changes, each a transform that sees the ones before it, written as one version."""
        table = self.find_all()
        for step in steps:
            table = step(table)
        return self.commit(table)

    def _current(self, like: DataFrame) -> DataFrame:
        return self.find_all() if self.version() or self.schema else like.limit(0)

    def check(self, table: DataFrame) -> None:
        """Raise unless keys are unique, references resolve and declared fields are there."""
        for columns in ([self.key], *self.unique):
            constraints.require(constraints.duplicates(table, *columns), f"duplicate {columns} in {self.name}")
        for columns in self.sparse:
            constraints.require(constraints.duplicates(table, *columns, sparse=True), f"duplicate {columns} in {self.name}")
        for fk, target in self.references.items():
            constraints.require(constraints.dangling(table, fk, target.find_all(), target.key), f"{fk} refers to nothing")
        if self.schema:
            constraints.require(constraints.violations(table, self.schema, self.strict), f"missing fields in {self.name}")

    def commit(self, table: DataFrame, checked: bool = False) -> str:
        """Write ``table`` as the next version, after the highest folder there is, complete or not."""
        self.store._writable()
        if not checked:
            self.check(table)
        taken = [int(v[1:]) for v in self.store._children(f"{self.store.path}/{self.name}") if v[:1] == "v" and v[1:].isdigit()]
        path = f"{self.store.path}/{self.name}/v{max(taken, default=0) + 1:08d}"
        self._sorted(table).write.mode("error").parquet(path)  # a second writer of the same version fails here
        return path

    def _sorted(self, table: DataFrame) -> DataFrame:
        return table.sortWithinPartitions(*self.layout) if self.layout else table

    def compact(self, files: int) -> str:
        return self.commit(self.find_all().repartition(files), checked=True)
