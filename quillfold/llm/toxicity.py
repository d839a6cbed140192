"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Each letter is predicted from the letters before it in its word (at most ``order - 1`` bytes, the
word's start included).  Both classes share one interpolated Kneser-Ney model: occurrences of the
longest n-grams, then continuation counts (distinct preceding letters) of all shorter ones, then all
bytes alike.  A class discounts its own counts of the longest n-grams and gives the freed mass, and
that of ``strength`` pseudo-counts, to the shared model, so a rare expression counts little until it
has been seen often enough in one class.

A word's evidence is its log-likelihood ratio (toxic over ordinary) beyond ``margin``; a text's is the
sum over its words divided by the root of their number, and one scale and one offset turn that into a
score.

Counts and probabilities are exact and are made by Spark aggregations and joins, order by order.  What
scoring needs of them is one number for each n-gram and each context: for a letter that a context has
never had, the shared probability cancels out of the ratio.  These numbers are broadcast while they
are few enough; beyond that the distinct words of the texts are joined with them.
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

from quillfold.llm.common import array_slices, fit_logistic, labelled, materialise, mix64, per_text, pieces, spare_name

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityConfig:
    order: int = 6  # bytes of an n-gram, 8 at most
    discount: float = 0.75  # of the shared model
    class_discount: float = 2.5
    strength: float = 20.0  # pseudo-counts of the shared model in a class
    margin: float = 1.5  # of a word's log-likelihood ratio
    calibration_share: int = 4  # one in so many learning rows may calibrate
    calibration_rows: int = 20_000  # bound of the sample that the scale and the offset are fitted on
    broadcast_rows: int = 8_000_000  # n-grams and contexts that are sent to the executors (16 bytes each and their index)
    folds: int = 5


def _words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _positions(words: list[str], cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed context, its length, and the byte that follows, ends of words among them; where words end."""
    joined = (" " + " ".join(words) + " ").encode("utf-8", "replace")
    b = np.frombuffer(joined, np.uint8).astype(np.uint64)
    n = len(b)
    place = np.arange(n)
    blank = b == 32
    reach = np.zeros(n, np.int64)
    reach[1:] = place[1:] - np.maximum.accumulate(np.where(blank, place, 0))[:-1]  # bytes back to the word's first blank
    context = np.zeros(n, np.uint64)  # the bytes before, packed; only those of the word count
    for k in range(1, min(cfg.order, n)):
        context[k:] |= b[: n - k] << np.uint64(8 * (k - 1))
    length = np.minimum(reach, cfg.order - 1)
    context &= np.array([(1 << (8 * k)) - 1 for k in range(cfg.order)], np.uint64)[length]
    return context[1:], length[1:], b[1:], np.flatnonzero(blank[1:])


def _runs(parts: list[str], limit: int = 1 << 19) -> Iterator[list[str]]:
    """Lists of texts of at most ``limit`` characters together (one text at least)."""
    run, size = [], 0
    for p in parts:
        if run and size + len(p) > limit:
            yield run
            run, size = [], 0
        run.append(p)
        size += len(p)
    if run:
        yield run


_COUNTS = ("c0", "c1", "h0", "h1")  # ordinary and toxic, first of the rows that do not calibrate


def _count_ngrams(rows: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """``g, n, c0, c1, h0, h1``: occurrences of the longest n-gram at each letter; ``n`` is its length."""

    def grams(tally: list[Counter]) -> Iterator[pa.RecordBatch]:
        for c, words in enumerate(tally):
            for part in _runs(list(words)):
                context, length, b, ends = _positions(part, cfg)
                times = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
                times = np.repeat(times, np.diff(np.r_[-1, ends]))
                g, first, at = np.unique((context << np.uint64(8)) | b, return_index=True, return_inverse=True)
                count = np.zeros(len(g), np.int64)
                np.add.at(count, at, times)
                n, none = length[first].astype(np.int32) + 1, np.zeros(len(g), np.int64)
                for s in range(0, len(g), 100_000):
                    cut = slice(s, s + 100_000)
                    four = [count[cut] if k == c else none[cut] for k in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)[cut]), pa.array(n[cut]), *map(pa.array, four)], ["g", "n", *_COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = [Counter() for _ in _COUNTS]
        for batch in batches:
            part = np.asarray(batch.column(1))
            for first, texts in array_slices(batch.column(0), 1 << 19):
                for t, y in zip(texts, part[first : first + len(texts)], strict=True):
                    for p in pieces(t or ""):
                        tally[y].update(_words(p))
                if sum(map(len, tally)) > 300_000:
                    yield from grams(tally)
                    tally = [Counter() for _ in _COUNTS]
        yield from grams(tally)

    part = F.when(F.col("label") > 0, 1).otherwise(0) + F.when(F.col("held"), 2).otherwise(0)
    counted = rows.select("text", part.alias("part")).mapInArrow(run, "g long, n int, c0 long, c1 long, h0 long, h1 long")
    return counted.groupBy("g").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in _COUNTS))


def _suffix(m: int) -> F.Column:
    """The last ``m`` bytes of an n-gram."""
    return F.col("g").bitwiseAND(F.lit((1 << (8 * m)) - 1))


def _context() -> F.Column:
    return F.shiftrightunsigned("g", 8).alias("h")


def _shared(counts: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """``g, p`` of every longest n-gram under the model of both classes, from ``g, n, c``."""
    occurring = counts.select("g", "n", "c")
    level, levels = occurring.where(F.col("n") == cfg.order), {}
    for m in range(cfg.order - 1, 0, -1):  # continuation counts: distinct letters before an n-gram of m bytes
        levels[m] = materialise(level.groupBy(_suffix(m).alias("g")).agg(F.count(F.lit(1)).alias("c")))
        level = levels[m].unionByName(occurring.where(F.col("n") == m).select("g", "c"))
    p = every = None
    for m in range(1, cfg.order):
        p = materialise(_interpolated(levels[m].select("g", "c", _suffix(m - 1).alias("s")), p, cfg.discount))
        every = p if every is None else every.unionByName(p)
    shorter = F.when(F.col("n") == cfg.order, _suffix(cfg.order - 1))
    for m in range(2, cfg.order):
        shorter = shorter.when(F.col("n") == m, _suffix(m - 1))
    return _interpolated(occurring.select("g", "c", shorter.alias("s")), every, cfg.discount)


def _interpolated(grams: DataFrame, lower: DataFrame | None, discount: float) -> DataFrame:
    """``g, p``: discounted counts ``c`` of a context plus the freed mass times ``p`` of the suffix ``s``."""
    by_context = grams.groupBy(_context()).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"))
    rows = grams.withColumn("h", _context()).join(by_context, "h")
    if lower is None:
        rows = rows.withColumn("q", F.lit(1 / 256))
    else:
        rows = rows.join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
    p = (F.greatest(F.col("c") - discount, F.lit(0.0)) + discount * F.col("k") * F.col("q")) / F.col("t")
    return rows.select("g", p.alias("p"))


def _ratio_tables(counts: DataFrame, cfg: ToxicityConfig) -> tuple[DataFrame, DataFrame]:
    """``key, ratio`` of the n-grams, and of the contexts for letters they have never had.

    ``counts`` has ``g, n, c0, c1``; the ratio is the logarithm of toxic over ordinary.
    """
    seen = counts.withColumn("c", F.col("c0") + F.col("c1")).where("c > 0")
    own = {k: F.greatest(F.col(f"c{k}") - cfg.class_discount, F.lit(0.0)) for k in (0, 1)}
    sums = [f(x).alias(n) for k in (0, 1) for f, x, n in ((F.sum, F.col(f"c{k}"), f"t{k}"), (F.sum, own[k], f"o{k}"))]
    contexts = materialise(seen.groupBy(_context()).agg(*sums))
    freed = {k: F.col(f"t{k}") - F.col(f"o{k}") + cfg.strength for k in (0, 1)}
    size = {k: F.col(f"t{k}") + cfg.strength for k in (0, 1)}
    rows = seen.withColumn("h", _context()).join(contexts, "h").join(_shared(seen, cfg), "g")
    p = {k: (own[k] + freed[k] * F.col("p")) / size[k] for k in (0, 1)}
    grams = rows.select(F.col("g").alias("key"), F.log(p[1] / p[0]).alias("ratio"))
    unseen = contexts.select(F.col("h").alias("key"), F.log(freed[1] / size[1] / (freed[0] / size[0])).alias("ratio"))
    return materialise(grams), materialise(unseen)


def _slots(keys: np.ndarray) -> np.ndarray:
    """Open-addressing table of the rows of distinct ``keys``, at most half full; -1 is free."""
    bits = max(4, (2 * len(keys) - 1).bit_length() if len(keys) else 0)
    slots = np.full(1 << bits, -1, np.int32)
    at, row = _bucket(keys, bits), np.arange(len(keys))
    while len(row):
        free = np.flatnonzero(slots[at] < 0)
        slots[at[free]] = row[free]
        left = slots[at] != row
        at, row = (at[left] + 1) & (len(slots) - 1), row[left]
    return slots


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(keys) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class _Table:
    """Ratios by packed key."""

    keys: np.ndarray
    ratio: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> _Table:
        t = table.toArrow()
        keys = np.asarray(t["key"]).view(np.uint64)
        return cls(keys, np.asarray(t["ratio"]), _slots(keys))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of ``keys``, 0 where they are missing, and which are there."""
        out, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
        at, todo = _bucket(keys, len(self.slots).bit_length() - 1), np.arange(len(keys))
        while len(todo):
            row = self.slots[at[todo]]
            held = row >= 0
            todo, row = todo[held], row[held]
            same = self.keys[row] == keys[todo]
            out[todo[same]], there[todo[same]] = self.ratio[row[same]], True
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return out, there


@dataclass
class _Local:
    """The ratios in memory: evidence of texts in numpy."""

    cfg: ToxicityConfig
    grams: _Table
    unseen: _Table

    def word_ratios(self, words: list[str]) -> np.ndarray:
        context, _, b, ends = _positions(words, self.cfg)
        ratio, there = self.grams.find((context << np.uint64(8)) | b)
        rest = np.flatnonzero(~there)
        ratio[rest] = self.unseen.find(context[rest])[0]
        return np.diff(np.r_[0.0, np.cumsum(ratio)[ends]])

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Evidence of every text; NaN for texts without words."""
        if len(texts) == 1 and texts[0] and len(texts[0]) > 1 << 20:  # a very long text is a slice of its own
            parts = [self._sums([p]) for p in pieces(texts[0])]
            total, n = (np.sum([p[k] for p in parts], axis=0) for k in (0, 1))
        else:
            total, n = self._sums(texts)
        return np.where(n > 0, total / np.sqrt(np.maximum(n, 1)), np.nan)

    def _sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = [_words(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        index: dict[str, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64, n.sum())
        if not index:
            return np.zeros(len(texts)), n
        beyond = np.maximum(self.word_ratios(list(index)) - self.cfg.margin, 0)
        return np.bincount(np.repeat(np.arange(len(texts)), n), weights=beyond[at], minlength=len(texts)), n


@dataclass
class ToxicityModel:
    """Tables of ratios in the shared folder, and a score from the evidence of a text."""

    cfg: ToxicityConfig
    grams: DataFrame
    unseen: DataFrame
    small: bool  # both tables may be sent to the executors
    scale: float = 0.0
    offset: float = 0.0
    prior: float = 0.0

    def evidence(self, docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """``docs`` with the evidence of a text; NaN for one without words."""
        if not self.small:
            return _joined_evidence(docs, self, text_col, out_col)
        shared = docs.sparkSession.sparkContext.broadcast(_Local(self.cfg, _Table.of(self.grams), _Table.of(self.unseen)))
        run = per_text(lambda: lambda texts: pa.array(shared.value.evidence(texts), pa.float64()), "double", 1 << 19)
        return docs.withColumn(out_col, run(F.col(text_col).cast("string")))

    def score(self, evidence: F.Column) -> F.Column:
        logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), evidence * self.scale + self.offset))
        return F.when(F.isnan(evidence) | F.lit(self.scale == 0), F.lit(self.prior)).otherwise(1 / (1 + F.exp(-logit)))


def _joined_evidence(docs: DataFrame, model: ToxicityModel, text_col: str, out_col: str) -> DataFrame:
    """The same by joins: texts' distinct words with the words' ratios, those with their letters' ratios."""
    cfg = model.cfg
    k1, k2 = (spare_name([*docs.columns, out_col], f"text_hash_{k}") for k in (1, 2))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(k1, F.xxhash64(text)).withColumn(k2, F.xxhash64(F.lit(1), text))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in array_slices(batch.column(2), 1 << 19):
                counts = []
                for t in texts:
                    seen: Counter = Counter()
                    for p in pieces(t or ""):
                        seen.update(_words(p))
                    counts.append(seen)
                at = pa.array([i for i, c in enumerate(counts, first) for _ in c], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([w for c in counts for w in c], pa.string()), pa.array([v for c in counts for v in c.values()], pa.int64())],
                    ["k1", "k2", "word", "n"],
                )

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch.column(0).to_pylist()):
                context, _, b, ends = _positions(part, cfg)
                owner = np.repeat(np.arange(len(part)), np.diff(np.r_[-1, ends]))
                for s in range(0, len(b), 100_000):
                    cut = slice(s, s + 100_000)
                    g = ((context << np.uint64(8)) | b)[cut].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()).take(pa.array(owner[cut])), pa.array(g), pa.array(context[cut].view(np.int64))], ["word", "g", "h"])

    rows = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text")).mapInArrow(tally, "k1 long, k2 long, word string, n long")
    rows = materialise(rows.dropDuplicates(["k1", "k2", "word"]))
    each = rows.select("word").distinct().mapInArrow(letters, "word string, g long, h long")
    each = each.join(model.grams.select(F.col("key").alias("g"), F.col("ratio").alias("r")), "g", "left")
    each = each.join(model.unseen.select(F.col("key").alias("h"), F.col("ratio").alias("u")), "h", "left")
    beyond = each.groupBy("word").agg((F.sum(F.coalesce("r", "u", F.lit(0.0))) - cfg.margin).alias("e")).where("e > 0")
    found = rows.join(beyond, "word", "left").groupBy("k1", "k2").agg((F.sum(F.col("n") * F.coalesce("e", F.lit(0.0))) / F.sqrt(F.sum("n"))).alias(out_col))
    found = found.withColumnsRenamed({"k1": k1, "k2": k2})
    plain = keyed.drop(*(c for c in docs.columns if c.lower() == out_col.lower()))
    out = plain.join(found, [k1, k2], "left").withColumn(out_col, F.coalesce(out_col, F.lit(float("nan"))))
    return out.select(*(F.col(c) for c in docs.columns if c.lower() != out_col.lower()), out_col)


def fit_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig(), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Count the n-grams of all labelled learning rows; fit scale and offset on some of them.

    These are chosen by a hash before anything is scored, at most ``calibration_rows`` of them, and
    are scored by a model that has not counted them; the final one counts them too.  Labels that an
    id repeats count as their largest; rows that repeat an id count each; rows without an id or a
    label are not learnt from.  Without a row of either class the score is the share of toxic labels
    (0 without labels).
    """
    with labelled(docs, labels, label_col, cfg.folds, id_col, text_col) as learn:
        h = F.xxhash64(F.col("doc_id").cast("string"))
        held = F.pmod(h, F.lit(cfg.calibration_share)) == 0
        most = learn.where(held).select(h.alias("h")).orderBy("h").limit(cfg.calibration_rows + 1).agg(F.max("h").alias("h"), F.count("h").alias("n")).first()
        if most.n > cfg.calibration_rows:
            held = held & (h < most.h)
        counts = materialise(_count_ngrams(learn.withColumn("held", held), cfg))
        model = _model(counts, cfg)
        rows = model.evidence(learn.where(held).select("text", "label"), "text", "x").where("not isnan(x)").select("x", "label").toArrow()
    x, y = np.asarray(rows["x"], float), np.minimum(np.asarray(rows["label"]), 1).astype(float)
    order = np.lexsort((y, x))  # the same fit whatever the partitions
    x, y = x[order], y[order]
    model = _model(counts.select("g", "n", (F.col("c0") + F.col("h0")).alias("c0"), (F.col("c1") + F.col("h1")).alias("c1")), cfg)
    model.prior = float(y.mean()) if len(y) else 0.0
    if len(y) and 0 < y.sum() < len(y):
        mean, std, w = fit_logistic(x[:, None], y)
        model.scale, model.offset = float(w[0] / std[0]), float(w[1] - w[0] * mean[0] / std[0])
    return model


def _model(counts: DataFrame, cfg: ToxicityConfig) -> ToxicityModel:
    grams, unseen = _ratio_tables(counts, cfg)
    return ToxicityModel(cfg, grams, unseen, grams.count() + unseen.count() <= cfg.broadcast_rows)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``out_col`` from 0 to 1.

    Defined cases: a null, empty or wordless text gets the share of toxic labels; very long texts
    are scored whole; repeated rows score alike; an existing column ``out_col`` is replaced; an empty
    table stays empty.
    """
    name = spare_name([*docs.columns, out_col], "evidence")
    return model.evidence(docs, text_col, name).withColumn(out_col, model.score(F.col(name))).drop(name)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    name = spare_name(docs.columns, "toxicity")
    return score_toxicity(docs, fit_toxicity(docs, labels, cfg), out_col=name).where(F.col(name) < threshold).select(*docs.columns)
