"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a text when a statistic exceeds a cutoff.  For every stratum and rule the cutoffs are
tested from the most lenient on: the hypothesis "more than ``alpha / rules`` of the good documents
are rejected" must be refuted by the exact binomial tail of the good documents that the cutoff
rejects.  The sequence stops at its first failure, so each (stratum, rule) is one test whatever the
number of cutoffs; Bonferroni covers the strata and rules.  With probability ``1 - delta`` no stratum
then loses more than ``alpha`` of its good documents to the rules.  Among the certified cutoffs the
one is used that catches most bad documents, a lost good one counting ``cost`` times; a stratum with too few labels for any
guarantee keeps everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import array_slices, labelled, per_text, small_side, spare_name, structs

_BLANK, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_KINDS = {n: pa.int64() for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")}

#: A rule is numerator over denominator.
RULES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "upper_case": ("n_upper", "n_letters"),
}
#: Cutoffs from lenient to strict; a text above a cutoff is rejected.
GRID = np.r_[np.geomspace(8, 1, 13), np.linspace(0.98, 0.02, 49)]


@dataclass(frozen=True)
class RuleConfig:
    alpha: float = 0.02  # bound on the good documents that the rules reject, in each stratum
    delta: float = 0.05  # probability that the bound fails in any stratum
    cost: float = 10.0  # of a share of good documents, in shares of bad ones, among certified cutoffs
    min_words: int = 50
    max_repeat_percent: int = 50


def _outside(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def _repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    w = np.fromiter((index.setdefault(x, len(index)) for x in words), np.int64, n)
    v = len(index)
    pair = w[:-2] * v + w[1:-1]
    if v > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair * v + w[2:], return_inverse=True, return_counts=True)
    often = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def _measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(_KINDS)
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    upper = _outside(b, _UPPER)
    return (
        len(words), len(text) - _outside(b, _BLANK), _outside(b, _SYMBOLS), len(lines),
        len(lines) - len(set(lines)), _repeat_words(words), upper, upper + _outside(b, _LOWER),
    )


def _statistics(texts: list[str | None]) -> pa.Array:
    rows = [_measure(t) for t in texts]
    return structs(_KINDS, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _KINDS])


def text_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """``docs`` with a struct of counts of the whole text; all zero for a null or empty text."""
    run = per_text(lambda: _statistics, ", ".join(f"{n} long" for n in _KINDS))
    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def base_failed(stats: Column, cfg: RuleConfig) -> Column:
    return (stats["n_words"] < cfg.min_words) | (100 * stats["n_repeat_words"] > cfg.max_repeat_percent * stats["n_words"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """``P(X <= k)`` for ``X`` binomial in ``n`` trials of probability ``p``, exactly."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    return float(min(1.0, np.exp(log_choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, level: float, cost: float = 10.0) -> float:
    """The cutoff to use, infinite if none is certified or useful.

    ``good[j]`` and ``bad[j]`` count the documents that pass exactly the last ``len(GRID) - j``
    cutoffs, so cutoff ``j`` rejects the sum of the counts after ``j``.
    """
    n, m = int(good.sum()), int(bad.sum())
    best, cutoff = 0.0, math.inf
    lost, caught = np.cumsum(good[::-1]), np.cumsum(bad[::-1])  # rejected at the 1st, 2nd, ... cutoff
    for j, c in enumerate(GRID):
        if n == 0 or binomial_tail(int(lost[j]), n, alpha) > level:
            break
        gain = (caught[j] / m if m else 0.0) - cost * lost[j] / n
        if gain > best + 1e-12:
            best, cutoff = gain, float(c)
    return cutoff


class Cutoffs(dict):
    """Cutoffs of the rules by stratum; infinite for a stratum that is not in it."""

    def __missing__(self, stratum: str) -> list[float]:
        return [math.inf] * len(RULES)


def _certified(hist: DataFrame, level: float, cfg: RuleConfig) -> DataFrame:
    """``stratum, cutoffs`` from ``stratum, cells``, a list of ``rule, step, label, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cells in batch.column(1).to_pylist():
                h = np.zeros((len(RULES), 2, len(GRID) + 1), np.int64)
                for c in cells:
                    h[c["rule"], max(0, c["label"]), c["step"]] += c["n"]
                found.append([certified_cutoff(x[1], x[0], cfg.alpha / len(RULES), level, cfg.cost) for x in h])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["stratum", "cutoffs"])

    return hist.select("stratum", "cells").mapInArrow(run, "stratum string, cutoffs array<double>")


def learn_cutoffs(
    docs: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig(), *, label_col: str = "quality", stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text"
) -> Cutoffs:
    """Cutoffs of the rules by stratum from all labelled documents that pass the base rules.

    Every labelled stratum is certified by itself, in Spark; ``""`` is that of rows without one.  The
    driver gets the strata in which a rule may reject: each of them has hundreds of good labels.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = GRID[::-1]
        for batch in batches:
            label, strata = batch.column(1), batch.column(2)
            for first, texts in array_slices(batch.column(0)):
                out: dict[str, list] = {"stratum": [], "rule": [], "step": [], "label": []}
                for i, t in enumerate(texts, first):
                    s = dict(zip(_KINDS, _measure(t), strict=True))
                    if s["n_words"] < cfg.min_words or 100 * s["n_repeat_words"] > cfg.max_repeat_percent * s["n_words"]:
                        continue
                    for r, (a, b) in enumerate(RULES.values()):
                        out["stratum"].append(strata[i].as_py()), out["label"].append(min(1, label[i].as_py())), out["rule"].append(r)
                        out["step"].append(int(np.searchsorted(steps, s[a] / max(1, s[b]), side="left")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["stratum"], pa.string()), *(pa.array(out[c], pa.int32()) for c in ("rule", "step", "label"))], list(out)
                )

    with labelled(docs, labels, label_col, None, id_col, text_col, stratum=stratum) as rows:
        counts = rows.select("text", "label", "stratum").mapInArrow(run, "stratum string, rule int, step int, label int")
        counts = counts.groupBy("stratum", "rule", "step", "label").agg(F.count(F.lit(1)).alias("n")).persist()
        cells = F.collect_list(F.struct("rule", "step", "label", "n")).alias("cells")
        n_strata = counts.select("stratum").union(docs.sparkSession.range(1).select(F.lit(""))).distinct().count()
        level = cfg.delta / (len(RULES) * n_strata)
        some = _certified(counts.groupBy("stratum").agg(cells), level, cfg).where(F.exists("cutoffs", lambda c: c < math.inf))
        found = Cutoffs({"": [math.inf] * len(RULES)} | {r.stratum: list(r.cutoffs) for r in some.collect()})
        counts.unpersist()
    return found


def apply_rules(docs: DataFrame, cutoffs: dict[str, list[float]], cfg: RuleConfig = RuleConfig(), *, stratum_col: str = "lang", text_col: str = "text", out_col: str = "rules") -> DataFrame:
    """``docs`` with a struct ``out_col``: the statistics, ``base_failed`` and ``kept``.

    Defined cases: a null or empty text has zero counts and fails the base rules; a null stratum is
    one like others; a stratum without cutoffs keeps all that the base rules keep; texts at a cutoff
    pass; repeated rows are judged alike; an existing column ``out_col`` is replaced; very long texts are measured whole.
    """
    stats_name = spare_name([*docs.columns, out_col], "stats")
    seen = text_statistics(docs, text_col, stats_name)
    stats = F.col(stats_name)
    key, limits_name = (spare_name([*seen.columns, out_col], n) for n in ("stratum", "limits"))
    table = docs.sparkSession.createDataFrame([(s, [float(v) for v in c]) for s, c in cutoffs.items()], f"{key} string, {limits_name} array<double>")
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    seen = seen.withColumn(key, stratum).join(small_side(table), key, "left")
    limits = F.coalesce(F.col(limits_name), F.lit(Cutoffs()[""]))
    failed = base_failed(stats, cfg)
    kept = ~failed
    for r, (a, b) in enumerate(RULES.values()):
        kept = kept & (stats[a] / F.greatest(stats[b], F.lit(1)) <= F.get(limits, F.lit(r)))
    verdict = F.struct(*(stats[n].alias(n) for n in _KINDS), failed.alias("base_failed"), kept.alias("kept"))
    return seen.withColumn(out_col, verdict).drop(stats_name, key, limits_name)


def drop_low_quality(docs: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    name = spare_name(docs.columns, "rules")
    judged = apply_rules(docs, learn_cutoffs(docs, labels, cfg), cfg, out_col=name)
    return judged.where(F.col(f"{name}.kept")).select(*docs.columns)
