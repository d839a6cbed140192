"""Helpers shared by the operators: shared-storage tables, text batches, hashing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the quality, mixing and near-duplicate contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table through Spark, so that any Hadoop-readable path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder for this session's intermediate tables inside ``spark.checkpoint.dir``.

    Executors and the driver all see that folder.  Where the setting is absent, a local one is made
    in local mode (tests), and anything else raises.  The folder is removed when the driver process ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="quillfold-")
            spark.sparkContext.setCheckpointDir(base)
        _SCRATCH[app] = f"{base.rstrip('/')}/quillfold-{app}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may already have ended; the folder then stays
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Parquet instead of ``checkpoint()`` keeps column pruning and compression, and the files survive
    the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """:func:`array_slices` of one column of a record batch."""
    return array_slices(batch.column(batch.schema.get_field_index(column)), max_bytes)


def array_slices(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Yield ``(first row, texts)`` with about ``max_bytes`` of UTF-8 in each slice.

    One text longer than that forms a slice of its own, so memory follows the longest text only.
    """
    if len(col) == 0:
        return
    if pa.types.is_null(col.type):
        yield 0, [None] * len(col)
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
    first = 0
    while first < len(col):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield first, col.slice(first, last - first).to_pylist()
        first = last


def pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """Cut a very long text at blanks or line ends, so that arrays over its letters stay small.

    A stretch of ``limit`` characters without either is cut where it is.
    """
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(" ", at, at + limit), text.rfind("\n", at, at + limit)) + 1
        cut = cut if cut > at else at + limit
        yield text[at:cut]
        at = cut
    yield text[at:]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer: spreads 64-bit values over all bits (wraps on overflow)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_fold(column: str, n: int) -> F.Column:
    """``crc32(id as text) mod n``; null where the id is null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def spare_name(columns: list[str], wanted: str) -> str:
    """``wanted`` or, where a column of the input has that name in any case, a longer one."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def per_text(make: Callable[[], Callable[[list[str | None]], pa.Array]], returns: str, max_bytes: int = 1 << 20) -> Callable[[F.Column], F.Column]:
    """An Arrow function of one text column, applied to slices of about ``max_bytes``.

    ``make`` runs once per task and gives the function from a list of texts to an Arrow array, so
    models and tables are built on the executors.  It counts as non-deterministic, which it is not, so
    that a filter on its result is not pushed below a join or projection, where it would run once more.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        function = make()
        for texts in batches:
            parts = [function(part) for _, part in array_slices(texts, max_bytes)]
            yield pa.concat_arrays(parts) if parts else function([])

    return run.asNondeterministic()


def structs(kinds: dict[str, pa.DataType], columns: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


#: A side of a join is broadcast up to this many bytes, as counted; beyond it, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Largest filter of ids, in bits (32 MB): beyond some 30 million ids it lets more and more rows pass.
FILTER_BITS = 28


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast join if a count of its bytes proves it small, else as it is."""
    return F.broadcast(df) if is_small(df)[0] else df


def is_small(df: DataFrame) -> tuple[bool, int]:
    """Whether ``df`` may be broadcast, and its number of rows."""
    size = F.lit(16)
    for f in df.schema:
        name = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
        else:
            size = size + F.lit(8)
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return (total or 0) <= BROADCAST_BYTES, n


def _filter_bits(h: F.Column, bits: int) -> list[F.Column]:
    return [h.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(h, 64 - bits)]


def _may_hold(ids: DataFrame, key: str, n: int) -> Callable[[F.Column], F.Column]:
    """A Bloom filter of the ids: false for most values that are not among them, true for all that are."""
    bits = min(FILTER_BITS, max(10, (8 * n).bit_length()))
    at = ids.select(F.explode(F.array(*_filter_bits(F.xxhash64(key), bits))).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[np.asarray(words["w"])] = np.asarray(words["v"]).view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(table)
    mask, top = np.uint64((1 << bits) - 1), np.uint64(64 - bits)

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        h = np.asarray(h).view(np.uint64)
        found = np.ones(len(h), bool)
        for b in (h & mask, h >> top):
            found &= (shared.value[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return pa.array(found)

    return lambda column: test(F.xxhash64(column))


def join_few(df: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """``df.join(few, key, how)`` for ``inner``, ``left``, ``left_semi`` and ``left_anti`` without shuffling most of ``df``.

    ``few``, which holds a value of ``key`` once, is broadcast if it is small.  Otherwise a Bloom
    filter of its keys goes to the executors; the rows of ``df`` that it excludes stay where they are,
    and only the others take part in the join.
    """
    small, n = is_small(few)
    if small:
        return df.join(F.broadcast(few), key, how)
    may = spare_name([*df.columns, *few.columns], "may_be_there")
    tested = df.withColumn(may, _may_hold(few, key, n)(F.col(key)))
    hit = tested.where(may).drop(may).join(few, key, how)
    if how in ("inner", "left_semi"):
        return hit
    return hit.unionByName(tested.where(~F.col(may)).drop(may), allowMissingColumns=True)


@contextmanager
def labelled(docs: DataFrame, labels: DataFrame, label_col: str, folds: int | None, id_col: str = "doc_id", text_col: str = "text", **also: F.Column) -> Iterator[DataFrame]:
    """The rows of ``docs`` that may be learnt from, as ``doc_id, text, label`` and further columns ``also``.

    These have a label and, if ``folds`` is given, ``crc32(id as text) mod folds != 0``.  Repeated labels of an id count as
    the largest of them.  Used in a ``with`` block, in which all jobs on the rows must run.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .where(crc_fold(id_col, folds) != 0 if folds else F.lit(True))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c.alias(n) for n, c in also.items()))
    known = known.persist()  # recomputed if an executor is lost; freed when the fit is done
    try:
        yield join_few(rows, known, "doc_id", "inner")
    finally:
        known.unpersist()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: ``(mean, scale, weights)``, intercept last."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w
