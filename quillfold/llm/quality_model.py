"""Quality scores from histogram gradient-boosted trees over statistics of the text.

Trees are complete binary trees of fixed depth, stored as flat arrays (feature, cut, leaf value), so
a batch of documents walks all trees at once in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import array_slices, labelled, per_text

_SENTENCE = re.compile(r"[.!?]")
_GROUPS = tuple(
    bytes(c for c in range(128) if test(chr(c)))
    for test in (str.isupper, str.islower, str.isdigit, lambda c: c in "#*$%&|<>", lambda c: c in ".,;:", lambda c: c in "!?", lambda c: c == "|", lambda c: c in " \t\n\r\x0b\x0c")
)


@dataclass(frozen=True)
class BoostConfig:
    sample: int = 20_000  # labelled documents the trees are fitted on (the bound of the sample)
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    min_leaf: int = 8
    folds: int = 5


def document_statistics(text: str | None) -> list[float]:
    """Counts and shares of one whole text; zeros for a null or empty one."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b)
    counts = [n - len(b.translate(None, g)) for g in _GROUPS]
    upper, lower, digit, symbol, stop, shout, pipe, blank = counts
    words = b.split()
    w = len(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    freq = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    line_freq = Counter(lines)
    solid = max(1, n - blank)
    top = sorted(freq.values(), reverse=True)[:10]
    return [
        np.log1p(w), upper / max(1, upper + lower), digit / solid, symbol / max(1, w), stop / max(1, w), shout / max(1, w), pipe / max(1, w),
        (n - blank) / max(1, w), len(freq) / max(1, w), pairs / max(1, w - 1), top[0] / w if w else 0.0, sum(top) / max(1, w),
        len(lines), w / max(1, len(lines)), 1 - len(line_freq) / max(1, len(lines)), sum(a == c for a, c in zip(words, words[1:], strict=False)) / max(1, w),
        len(_SENTENCE.findall(text or "")) / max(1, w), (solid - upper - lower - digit - symbol - stop - shout) / solid,
    ]


@dataclass
class Boosted:
    feature: np.ndarray  # [trees, inner nodes]
    cut: np.ndarray  # [trees, inner nodes]; larger values go right
    leaf: np.ndarray  # [trees, leaves]
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row."""
        if not len(self.feature) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        trees, inner = np.arange(len(self.feature))[None, :], self.feature.shape[1]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        while node[0, 0] < inner:
            value = np.take_along_axis(x, self.feature[trees, node], axis=1)
            node = 2 * node + 1 + (value > self.cut[trees, node])
        return 1 / (1 + np.exp(-np.clip(self.start + self.leaf[trees, node - inner].sum(axis=1), -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, cfg: BoostConfig = BoostConfig()) -> Boosted:
    """Second-order boosting of the logistic loss over binned features."""
    n, m = x.shape
    rate = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**cfg.depth - 1, 2**cfg.depth
    model = Boosted(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if not n or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1])) for f in range(m)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], axis=1)  # x > edge[j] iff code > j
    raw = np.full(n, start)
    feature, cut, leaf = [], [], []
    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        tf, tc = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for d in range(cfg.depth):
            base, width = 2**d - 1, 2**d
            local = node - base
            best = np.full(width, 1e-6)
            pick: list[tuple[int, int] | None] = [None] * width
            for f in range(m):
                if not len(edges[f]):
                    continue
                b = len(edges[f]) + 1
                key = local * b + code[:, f]
                sums = [np.bincount(key, weights=v, minlength=width * b).reshape(width, b) for v in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = [s.cumsum(axis=1)[:, :-1] for s in sums], [s.sum(axis=1, keepdims=True) for s in sums]
                gain = gl**2 / (hl + cfg.ridge) + (gt - gl) ** 2 / (ht - hl + cfg.ridge) - gt**2 / (ht + cfg.ridge)
                gain[(nl < cfg.min_leaf) | (nt - nl < cfg.min_leaf)] = 0
                j = gain.argmax(axis=1)
                top = gain[np.arange(width), j]
                for k in np.flatnonzero(top > best):
                    best[k], pick[k] = top[k], (f, int(j[k]))
            right = np.zeros(n, bool)
            for k, s in enumerate(pick):
                if s:
                    tf[base + k], tc[base + k] = s[0], edges[s[0]][s[1]]
                    here = local == k
                    right[here] = code[here, s[0]] > s[1]
            node = 2 * node + 1 + right
        at = node - inner
        value = cfg.rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + cfg.ridge)
        raw += value[at]
        feature.append(tf), cut.append(tc), leaf.append(value)
    return Boosted(np.array(feature), np.array(cut), np.array(leaf), start)


def fit_quality(docs: DataFrame, labels: DataFrame, cfg: BoostConfig = BoostConfig(), *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Boosted:
    """Fit on at most ``cfg.sample`` labelled learning rows of ``docs``, chosen by a hash of id and text.

    The rows are measured on the executors; the driver gets the statistics of the chosen ones only.
    Labels of ids that are not in ``docs`` take no place in the sample.  Labels that an id repeats
    count as their largest; rows that repeat an id are rows of their own, ties of the hash go by their
    statistics.  With one class or no labels the score is the share of label 1 (one half without
    labels).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in array_slices(batch.column(0)):
                x = pa.array([document_statistics(t) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([x, *(batch.column(k).slice(first, len(texts)) for k in (1, 2))], ["x", "label", "h"])

    with labelled(docs, labels, label_col, cfg.folds, id_col, text_col) as rows:
        hashed = rows.select("text", "label", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
        most = hashed.select("h").orderBy("h").limit(cfg.sample + 1).agg(F.max("h").alias("h"), F.count("h").alias("n")).first()
        near = hashed.where(F.col("h") <= most.h) if most.n > cfg.sample else hashed  # only these are measured
        got = near.mapInArrow(run, "x array<double>, label int, h long").orderBy("h", "x", "label").limit(cfg.sample).toArrow()
    order = sorted(zip(got["x"].to_pylist(), got["label"].to_pylist(), strict=True))  # the same trees whatever the partitions
    x = np.array([r[0] for r in order], float) if order else np.zeros((0, 1))
    return fit_boosted(x, np.array([min(1, max(0, r[1])) for r in order], float), cfg)


def score_quality(docs: DataFrame, model: Boosted, *, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with a double ``out_col`` from 0 to 1, higher for likelier label 1.

    Defined cases: a null or empty text is scored by its zero statistics; very long texts are
    measured whole; repeated rows score alike; an existing column ``out_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts: list[str | None]) -> pa.Array:
            out = [shared.value.scores(np.array([document_statistics(t) for t in texts[s : s + 1024]], float)) for s in range(0, len(texts), 1024)]
            return pa.array(np.concatenate(out) if out else [], pa.float64())

        return run

    return docs.withColumn(out_col, per_text(make, "double")(F.col(text_col).cast("string")))
