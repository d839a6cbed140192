"""Near-duplicate groups: MinHash bands, signature check, exact check, connected components.

Plan
----
1. One Arrow pass over the texts gives, per document, the size of its shingle set, a 64-bit class id
   (hash of the whole set, so exact copies share it), the band hashes and the signature.
2. ``groupBy(band hash)`` with ``min``/``max`` of the class id finds the bands that hold different
   texts.  It is partially aggregated, so thousands of copies in one band are one row per task.
3. Within such a band every class is paired with two centres (stars, not all pairs).
   Signatures drop the pairs that are clearly too far; the rest are confirmed on their full sets.
4. Components of the confirmed links.  The classes of bands that still hold different components are
   searched once more, by an exact filter on their differences from the group's common core.
   Pairs of one component can add nothing, so after that no link between components is left untried.

The texts are read once in full and again for the members of tried pairs.  Those are found by their
broadcast ids or, if these are too many, by a join of the texts that a Bloom filter of the ids lets
pass; all other texts stay in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import join_few, materialise, mix64, text_slices
from quillfold.llm.components import connected_components

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class NearDup:
    """Settings.  A link at similarity 0.8 is missed with probability ``(1 - 0.8**rows)**bands``."""

    shingle_words: int = 5
    percent: int = 80  # linked if 100 * intersection >= percent * union
    bands: int = 30
    rows: int = 5  # the defaults miss 7 links in a million at the very threshold
    slack: float = 0.2  # signature estimates below threshold - slack are not confirmed (6 sigma)
    seed: int = 1234567


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``n``-grams; the whole text if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(w))
    grams = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):  # a polynomial in the order of the words
        grams = grams * np.uint64(_MULTIPLIERS[0]) + w[k : len(w) - n + 1 + k]
    return np.unique(mix64(grams))


def class_id(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)))))


def _signer(cfg: NearDup):
    """The multiply-shift family ``(a * x + b) mod 2**64 >> 32`` with fixed odd multipliers."""
    rng = np.random.default_rng(cfg.seed)
    k = cfg.bands * cfg.rows
    a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(x: np.ndarray) -> np.ndarray:
        low = None
        for s in range(0, len(x), 256):
            part = x[s : s + 256, None] * a
            part += b
            part = part.min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low >> np.uint64(32)  # the order of the upper halves is that of the whole

    def band_hashes(low: np.ndarray) -> np.ndarray:
        rows = low.reshape(len(low), cfg.bands, cfg.rows)
        h = np.arange(1, cfg.bands + 1, dtype=np.uint64) * np.uint64(_MULTIPLIERS[0])
        for r in range(cfg.rows):
            h = mix64(h * np.uint64(_MULTIPLIERS[1]) + rows[:, :, r])
        return h.view(np.int64)

    return minima, band_hashes


def sketch(docs: DataFrame, cfg: NearDup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, cid, bands, sig``; a text without words has null ``cid`` and arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, band_hashes = _signer(cfg)
        for batch in batches:
            for first, texts in text_slices(batch):
                sets = [shingle_hashes(words_of(t), cfg.shingle_words) for t in texts]
                full = [g for g in sets if len(g)]
                low = np.array([minima(g) for g in full], np.uint64).reshape(len(full), cfg.bands * cfg.rows)
                bands, sig = iter(band_hashes(low)), iter(low.astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(g) for g in sets], pa.int64()),
                        pa.array([class_id(g) if len(g) else None for g in sets], pa.int64()),
                        pa.array([next(bands) if len(g) else None for g in sets], pa.list_(pa.int64())),
                        pa.array([next(sig) if len(g) else None for g in sets], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n_shingles", "cid", "bands", "sig"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, cid long, bands array<long>, sig array<int>")


def _sets(docs: DataFrame, wanted: DataFrame, cfg: NearDup, id_col: str, text_col: str) -> DataFrame:
    """``cid, grams`` of the wanted classes, from the text of one member each (``doc_id``, ``cid``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch):
                sets = [shingle_hashes(words_of(t), cfg.shingle_words) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_id(g) for g in sets], pa.int64()), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))],
                    ["cid", "grams"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = join_few(rows.where(F.col("text").isNotNull()), wanted.select("doc_id"), "doc_id", "left_semi").select("text")
    return some.mapInArrow(run, "cid long, grams array<long>").dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, gb = batch.column(2), batch.column(3)
            ok = []
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values).view(np.uint64) for c in (ga, gb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("cid").alias("b"), F.col("grams").alias("gb"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ga", "gb")
    return rows.mapInArrow(run, "a long, b long")


def _close_enough(pairs: DataFrame, classes: DataFrame, cfg: NearDup) -> DataFrame:
    """Drop pairs whose sizes exclude the similarity, or whose signatures agree far too seldom."""
    least = max(0.0, cfg.percent / 100 - cfg.slack) * cfg.bands * cfg.rows
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    sized = 100 * F.least("na", "nb") >= cfg.percent * F.greatest("na", "nb")
    return pairs.join(right, "b").join(left, "a").where(sized).where(agree >= least).select("a", "b")


def near_duplicates(docs: DataFrame, cfg: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``.

    Texts are linked when ``100 * |A and B| >= percent * |A or B|`` over their shingle sets;
    ``component_id`` is the smallest id reachable over links and ``kept`` marks it.  Exact copies
    are one class and are never paired.

    Defined cases: a null or blank text has an empty set and is linked with nothing; a text with
    fewer words than a shingle is one shingle; a row with a null id is linked with nothing, has a
    null ``component_id`` and is kept; rows that repeat an id are texts of one document: each has a
    row, joined to the groups of its own text; other columns are ignored whatever their names; an
    empty table gives an empty result.  64-bit hashes stand for shingles and sets.
    """
    drawn = materialise(sketch(docs, cfg, id_col, text_col))
    full = drawn.where(F.col("cid").isNotNull() & F.col("doc_id").isNotNull())
    banded = full.select(F.explode("bands").alias("bk"), "cid")
    mixed = materialise(
        banded.groupBy("bk").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where(F.col("lo") < F.col("hi"))
    )
    # the classes of every band that holds more than one
    members = materialise(_centres(materialise(banded.join(mixed, "bk").select("bk", "cid", "lo").distinct())))
    stars = (
        members.select(F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("cid").alias("y")), F.struct(F.col("mid").alias("x"), F.col("cid").alias("y")))).alias("p"))
        .select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b"))
        .where(F.col("a") < F.col("b"))
        .distinct()
    )
    classes = materialise(
        join_few(full, materialise(members.select("cid").distinct()), "cid", "left_semi")
        .groupBy("cid")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    )
    tried = materialise(_close_enough(stars, classes, cfg))
    sets = materialise(_sets(docs, materialise(classes.join(_ends(tried), "cid", "left_semi").select("doc_id")), cfg, id_col, text_col))
    links = materialise(_confirmed(tried, sets, cfg.percent))
    labels = materialise(connected_components(links))

    rest = materialise(_open_classes(members, labels))
    wanted = rest.select("cid").distinct()
    lacking = materialise(classes.join(wanted, "cid", "left_semi").join(sets.select("cid"), "cid", "left_anti"))
    added = _sets(docs, lacking, cfg, id_col, text_col).join(sets.select("cid"), "cid", "left_anti")
    sets = sets.unionByName(materialise(added))
    more = _close_enough(_pivot_pairs(rest, sets, cfg.percent), classes, cfg)
    more = materialise(more.join(tried, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = links.unionByName(_confirmed(more, sets, cfg.percent))
        labels = materialise(connected_components(links))

    keyed = full.select("doc_id", "n_shingles", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    keyed = keyed.select("doc_id", "n_shingles", F.coalesce("component", "cid").alias("key"))
    # only groups of several rows are joined back, from a table: a hot group's rows can then be split
    least = materialise(keyed.groupBy("key").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    grouped = keyed.join(least, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    single = drawn.where(F.col("cid").isNull() | F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return grouped.unionByName(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def _centres(members: DataFrame) -> DataFrame:
    """``members`` with ``mid``, the centre of their band.

    The text that a group's copies were made from is closest to all of them, so it shares most
    bands with others.  Every class takes the class with most company in any of its bands, and a
    band takes the best of what its classes take: nearly all bands of a group get that one text as
    their centre, even where it is not in them.
    """
    sizes = members.groupBy("bk").agg(F.count(F.lit(1)).alias("n"))
    met = members.join(sizes, "bk").groupBy("cid").agg(F.sum("n").alias("met"))
    tops = members.join(met, "cid").groupBy("bk").agg(F.max(F.struct("met", "cid")).alias("top"))
    best = members.join(tops, "bk").groupBy("cid").agg(F.max("top").alias("best"))
    mids = members.join(best, "cid").groupBy("bk").agg(F.max("best")["cid"].alias("mid"))
    return members.join(mids, "bk")


def _open_classes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``mid, cid, comp`` of the bands of three or more classes that lie in different components."""
    at = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        "bk", "mid", "cid", F.coalesce("component", "cid").alias("comp")
    )
    bands = at.groupBy("bk").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"))
    rows = at.join(bands.where("n > 2 and low < high").select("bk"), "bk", "left_semi")
    return rows.select("mid", "cid", "comp").distinct()


def _hashed_counts(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """How often values occur, in ``2**bits`` hashed buckets: a bounded table for the driver."""
    counts = np.zeros(1 << bits, np.int64)
    bucket = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    for batch in values.groupBy(bucket.alias("g")).agg(F.count(F.lit(1)).alias("n")).toArrow().to_batches():
        counts[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
    return counts


def _pivot_pairs(rest: DataFrame, sets: DataFrame, percent: int, bits: int = 20, core_share: float = 0.3) -> DataFrame:
    """All pairs ``a, b`` of one group (``mid``) and two components that may be linked.

    A group's core ``c`` holds the shingles of at least ``core_share`` of its sets, and may be empty.  A set ``x`` is
    described by its differences from the core: ``D(x)``, the ``M`` shingles of the core it lacks and
    the ``A`` it has besides.  With ``w(x) = 100 M + percent A``, ``x`` and ``y`` are linked exactly if

        (100 + percent) * |D(x) & D(y)|  >=  w(x) + w(y) - (100 - percent) * |c|.

    Where the right side is not positive, both are linked to the set of smallest ``w``, and are
    paired with that.  All other pairs must share differences: they meet on a prefix of ``D`` in one
    common order (rare ones first; those that occur once never meet), as short as the right side
    allows, and only where enough differences may follow.  What the copies of a large group, or texts
    with a common passage, have in common is in the core and pairs nothing.
    """
    spark = sets.sparkSession
    mask = (1 << bits) - 1
    own = sets.select("cid", "grams")
    sizes = rest.groupBy("mid").agg(F.count(F.lit(1)).alias("size"))
    often = rest.join(own, "cid").select("mid", F.explode("grams").alias("g")).groupBy("mid", "g").agg(F.count(F.lit(1)).alias("k"))
    core = often.join(sizes, "mid").where(F.col("k") >= core_share * F.col("size")).groupBy("mid").agg(F.collect_list("g").alias("core"))
    core = materialise(core)  # joined as a table, so that the rows of a large group can be split

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mid, cid, comp = (np.asarray(batch.column(k)) for k in range(3))
            w, c_size, diff = [], [], []
            for m, x, c in zip(mid, batch.column(3), batch.column(4), strict=True):
                x, c = (np.asarray(v.values).view(np.uint64) for v in (x, c))
                lacks, adds = np.setdiff1d(c, x, assume_unique=True), np.setdiff1d(x, c, assume_unique=True)
                salt = mix64(np.array([m]).view(np.uint64))
                diff.append(np.r_[mix64(lacks ^ salt), mix64(~adds ^ salt)].view(np.int64))
                w.append(100 * len(lacks) + percent * len(adds)), c_size.append((100 - percent) * len(c))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mid), pa.array(cid), pa.array(comp), pa.array(w, pa.int64()), pa.array(c_size, pa.int64()), pa.array(diff, pa.list_(pa.int64()))],
                ["mid", "cid", "comp", "w", "c", "diff"],
            )

    none = F.array().cast("array<long>")  # a group in which no shingle is common enough: D(x) = x
    rows = rest.join(own, "cid").join(core, "mid", "left").select("mid", "cid", "comp", "grams", F.coalesce("core", none).alias("core"))
    rows = materialise(rows.mapInArrow(differ, "mid long, cid long, comp long, w long, c long, diff array<long>"))
    counts = spark.sparkContext.broadcast(_hashed_counts(rows.select(F.explode("diff").alias("f")), "f", bits))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each feature of the longer prefix; ``low`` says whether it is in the shorter one."""
        for batch in batches:
            mid, cid, comp, w, c, least = (np.asarray(batch.column(k)) for k in range(6))
            f, low, left, at = [], [], [], []
            for i, d in enumerate(batch.column(6)):
                d = np.asarray(d.values)
                n = counts.value[d & mask]
                d, n = d[n > 1], n[n > 1]
                d = d[np.lexsort((d, n))]
                need = [max(1, -(-(int(w[i]) + int(o) - int(c[i])) // (100 + percent))) for o in (w[i], least[i])]
                short, long_ = (max(0, len(d) - q + 1) for q in need)
                f.append(d[:long_])
                low.append(np.arange(long_) < short)
                left.append(len(d) - np.arange(long_))
                at.append(np.full(long_, i))
            at = np.concatenate(at).astype(np.int64) if at else np.empty(0, np.int64)
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (mid[at], cid[at], comp[at], w[at], c[at], join(f, np.int64), join(low, bool), join(left, np.int64))],
                ["mid", "cid", "comp", "w", "c", "f", "low", "left"],
            )

    nearest = materialise(rows.groupBy("mid").agg(F.min(F.struct("w", "cid", "comp")).alias("top")))
    ranked = rows.join(nearest, "mid")
    heads = materialise(
        ranked.select("mid", "cid", "comp", "w", "c", F.col("top.w").alias("least"), "diff").mapInArrow(
            prefixes, "mid long, cid long, comp long, w long, c long, f long, low boolean, left long"
        )
    )
    # a difference that only one component has pairs nothing: the copies of one family don't meet on it
    crossing = heads.groupBy("mid", "f").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("mid", "f")
    one = heads.where("low").join(crossing, ["mid", "f"], "left_semi").select("mid", "f", *(F.col(k).alias(f"{k}1") for k in ("cid", "comp", "w", "left")))
    two = heads.select("mid", "f", "c", *(F.col(k).alias(f"{k}2") for k in ("cid", "comp", "w", "left")))
    enough = (100 + percent) * F.least("left1", "left2") >= F.col("w1") + F.col("w2") - F.col("c")
    order = (F.col("w1") < F.col("w2")) | ((F.col("w1") == F.col("w2")) & (F.col("cid1") < F.col("cid2")))
    meet = one.join(two, ["mid", "f"]).where((F.col("comp1") != F.col("comp2")) & order & enough)
    stars = ranked.where((F.col("w") + F.col("top.w") <= F.col("c")) & (F.col("comp") != F.col("top.comp"))).select(F.col("cid").alias("cid1"), F.col("top.cid").alias("cid2"))
    both = meet.select("cid1", "cid2").unionByName(stars)
    return both.select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, cfg: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns.

    Rows that repeat an id keep one row.  Rows with a null id stay.
    """
    found = near_duplicates(docs, cfg, id_col, text_col)
    per_id = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.bool_and("kept").alias("k"), F.count(F.lit(1)).alias("n")
    )
    odd = materialise(per_id.where(~F.col("k") | (F.col("n") > 1)).select(F.col("doc_id").alias(id_col), "k"))
    twice = odd.where("k").select(id_col)
    plain = join_few(docs, odd.select(id_col), id_col, "left_anti").select(*docs.columns)
    again = join_few(docs, twice, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    return plain.unionByName(again)
