"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is ``r`` times its size takes every document ``floor(r)`` times and once more
with probability ``r - floor(r)``.  The flight phase moves these probabilities along the null space
of two constraints (words and documents), three units at a time, until all but two of a block are 0
or 1; both totals stay exactly as they were.  Blocks of about ``block`` units run in parallel,
whatever the size of a source; what they leave meets in fewer blocks, level by level, until one
block per source is left, whose last few units are rounded together so that the words come nearest
the target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfold.llm.common import WORD, join_few, materialise, small_side, spare_name

_EPS = 1e-9


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources in order, repeating
    share: float = 1.0  # of all words
    max_repeats: int = 3  # a source's target is at most so many times its size
    block: int = 2000
    landing: int = 14  # units of a source that the landing phase decides together
    seed: int = 20240101


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 in code point order, null last, without one task seeing all rows."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = materialise(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    offsets, start = {}, 0
    for r in sorted(parts.groupBy("part").count().collect()):
        offsets[r["part"]], start = start, start + r["count"]
    table = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)) if offsets else None
    row = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("rank", (F.element_at(table, F.col("part")) if offsets else F.lit(0)) + row - 1).drop("part")


def source_targets(units: DataFrame, cfg: MixConfig) -> DataFrame:
    """``source, source_size, n, rank, target`` by filling up: excess over the cap goes to the rest."""
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in cfg.weights)), (F.col("rank") % len(cfg.weights)).cast("int"))
    table = materialise(_ranked(found).withColumn("weight", weight))
    cap = cfg.max_repeats * F.col("source_size")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * cfg.share
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        n, held, open_ = table.agg(
            F.count_if(above), F.sum(F.when(above, cap).otherwise(F.lit(0))), F.sum(F.when(above, F.lit(0.0)).otherwise(F.col("weight")))
        ).first()
        if n == full or not open_:
            break
        full, level = n, (total - held) / open_
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def _fly(x: list[float], c: list[float], p: list[float], rng: np.random.Generator, leave: int = 2) -> list[float]:
    """Flight phase over units in order, until at most ``leave`` stay between 0 and 1."""
    p, active, after = list(p), [], 0
    open_ = sum(_EPS < v < 1 - _EPS for v in p)
    while open_ > leave:
        while len(active) < 3 and after < len(p):
            if _EPS < p[after] < 1 - _EPS:
                active.append(after)
            after += 1
        if len(active) < 3:
            break
        i, j, k = active
        u = (x[j] * c[k] - x[k] * c[j], x[k] * c[i] - x[i] * c[k], x[i] * c[j] - x[j] * c[i])
        if max(map(abs, u)) < 1e-12:  # both constraints say the same
            u = (c[j], -c[i], 0.0) if c[i] or c[j] else (1.0, 0.0, 0.0)
        up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in zip(active, u, strict=True) if d)
        down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in zip(active, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for a, d in zip(active, u, strict=True):
            p[a] = min(1.0, max(0.0, p[a] + step * d))
            if p[a] < _EPS or p[a] > 1 - _EPS:
                p[a] = float(round(p[a]))
        before, active = len(active), [a for a in active if _EPS < p[a] < 1 - _EPS]
        open_ -= before - len(active)
    return p


def _landing_last(at: np.ndarray, k: int) -> np.ndarray:
    """Move ``k`` units to the end of an ascending order: the largest, and some of every size class.

    The flight then leaves these to the landing, and their sums come near almost any number.
    """
    n, chosen = len(at), []
    for i in [n - 1 - j for j in range(k // 2)] + [n >> j for j in range(1, n.bit_length())]:
        if 0 <= i < n and i not in chosen and len(chosen) < k:
            chosen.append(i)
    return np.r_[np.delete(at, chosen), at[chosen]]


def _land(x: list[float], c: list[float], p: list[float]) -> list[float]:
    """Round the last few units together so that words, then documents, stay nearest."""
    left = np.array([i for i, v in enumerate(p) if _EPS < v < 1 - _EPS], int)
    if not len(left):
        return p
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    moved = ways - np.asarray(p)[left]
    words, units = np.abs(moved @ np.asarray(x)[left]), np.abs(moved @ np.asarray(c)[left])
    best = ways[np.argmin(words / max(1.0, np.asarray(x)[left].mean()) + 0.01 * units)]
    p = list(p)
    for i, v in zip(left, best, strict=True):
        p[i] = float(v)
    return p


def _level(units: DataFrame, level: int, cfg: MixConfig) -> DataFrame:
    """One round of blocks over ``rank, h, doc_id, source, size, m, p, blocks``."""

    def run(table: pa.Table) -> pa.Table:
        last = table["blocks"][0].as_py() == 1
        at = np.lexsort((np.asarray(table["h"]), np.asarray(table["size"]) * np.asarray(table["m"])))
        table = table.take(pa.array(_landing_last(at, cfg.landing) if last else at))
        m = np.asarray(table["m"], dtype=float)
        x, c, p = (np.asarray(table["size"], dtype=float) * m).tolist(), m.tolist(), table["p"].to_pylist()
        key = (cfg.seed, level, int(table["rank"][0].as_py()), int(table["block"][0].as_py()))
        p = _fly(x, c, p, np.random.default_rng(key), cfg.landing if last else 2)
        if last:
            p = _land(x, c, p)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    # another hash at every level, so that the blocks of one level spread over those of the next
    dealt = units.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
    return materialise(dealt.groupBy("rank", "block").applyInArrow(run, dealt.schema))


def mix(docs: DataFrame, cfg: MixConfig = MixConfig(), *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` is the number of words; a source's ``target`` is its weighted share of all words, at
    most ``max_repeats`` times its size, the excess reshared; ``copies`` says how often the mix takes
    the document and ``taken`` is ``copies * size``.

    Defined cases: a null or wordless text has size 0; a null source is a source of its own, last in
    the order; rows equal in id, source and size share one decision; results depend on the rows and
    the seed only, not on partitions; other columns are ignored; an empty table gives an empty
    result.
    """
    each = _decided(docs, cfg, id_col, source_col, text_col).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    copies = F.col("base") + F.col("more")
    return each.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _decided(docs: DataFrame, cfg: MixConfig, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``doc_id, source, size, m, source_size, target, base, more``: ``m`` equal rows are taken ``base + more`` times, ``more`` 0 or 1."""
    text_of = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    units = materialise(text_of.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    sources = small_side(source_targets(units, cfg))
    ratio = F.col("target") / F.col("source_size")
    known = units.join(sources, units["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    known = known.withColumn("r", F.when(F.col("source_size") > 0, ratio).otherwise(F.lit(0.0)))
    known = known.withColumn("base", F.floor(F.col("r") + _EPS).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("r") - F.col("base")))
    known = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "source", "size", F.lit(cfg.seed)))
    keep = ["rank", "h", "doc_id", "source", "size", "m", "source_size", "target", "base", "p"]
    open_ = known.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / cfg.block))).select(*keep, "blocks")
    undecided = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    done = [known.where(~undecided).select(*keep)]
    level = 0
    open_ = open_.where(undecided)
    while True:
        flown = _level(open_, level, cfg)
        done.append(flown.where(~undecided).select(*keep))
        left = flown.where(undecided)
        counts = left.groupBy("rank").agg(F.count(F.lit(1)).alias("k"))
        if not counts.limit(1).count():
            break
        per = small_side(counts.select("rank", F.ceil(F.col("k") / cfg.block).alias("blocks")))
        open_ = left.select(*keep).join(per, "rank")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "m", "source_size", "target", "base", F.round("p").cast("long").alias("more"))


def take_mix(docs: DataFrame, cfg: MixConfig = MixConfig(), *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with ``copy`` from 1 on.

    All documents of a source are taken either ``base`` or ``base + 1`` times; only the ids of the
    rarer of the two are joined to the documents.  A column of ``docs`` named ``copy`` is replaced;
    other cases as in :func:`mix`.
    """
    units = materialise(_decided(docs, cfg, id_col, source_col, text_col).select("doc_id", "source", "size", "base", "more").distinct())
    usual = units.groupBy("source").agg(F.max("base").alias("base"), F.when(2 * F.sum("more") > F.count(F.lit(1)), 1).otherwise(0).alias("usual"))
    usual = materialise(usual.select(F.col("source").alias("of"), "base", "usual"))
    key, mark, of, base, most = (spare_name([*docs.columns, "copy"], n) for n in ("mix_key", "mix_other", "mix_source", "mix_base", "mix_usual"))
    row_key = lambda i, s, n: F.unhex(F.md5(F.to_json(F.struct(i.cast("string").alias("i"), s.cast("string").alias("s"), n.alias("n")))))
    small = small_side(usual)
    other = units.join(small, units["source"].eqNullSafe(small["of"])).where(F.col("more") != F.col("usual"))
    other = materialise(other.select(row_key(F.col("doc_id"), F.col("source"), F.col("size")).alias(key), F.lit(True).alias(mark)))
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(source_col), word_count(F.col(text_col))))
    found = join_few(keyed, other, key, "left")
    sources = small_side(usual.select(F.col("of").alias(of), F.col("base").alias(base), F.col("usual").alias(most)))
    found = found.join(sources, found[source_col].cast("string").eqNullSafe(sources[of]), "left")
    copies = F.col(base) + F.when(F.col(mark), 1 - F.col(most)).otherwise(F.col(most))
    kept = [F.col(c) for c in docs.columns if c.lower() != "copy"]
    return found.where(copies > 0).select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
