"""Language identification by nearest centroids of TF-IDF weighted letter n-grams.

Document frequencies come from every row that may be learnt from; the same pass over the texts finds
the sample of each language.  The centroids of a language are found by spherical k-means in one task
per language over its sample.  A text gets
the language of the centroid with the largest cosine; texts further from it than almost all training
texts of that language are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfold.llm.common import array_slices, crc_fold, materialise, per_text, pieces, small_side, structs

#: Bytes other than letters and non-ASCII become blanks.
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class LanguageConfig:
    sizes: tuple[int, ...] = (1, 2, 3)  # bytes of an n-gram
    dims: int = 4096  # hashed dimensions
    tf_power: float = 1.0  # term weights are counts to this power times inverse document frequencies
    centroids: int = 4  # per language
    sample: int = 400  # training texts per language for the centroids (the bound of the sample)
    rejection: float = 0.002  # share of a language's sample that is further away than the limit
    folds: int = 4
    held_out: int = 2


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(texts: list[str | None], cfg: LanguageConfig) -> np.ndarray:
    """Dense counts ``[texts, dims]`` of the hashed byte n-grams of lower-cased letters."""
    if any(t and len(t) > 1 << 20 for t in texts):  # very long texts piece by piece
        return np.concatenate([sum(ngram_counts([p], cfg) for p in pieces(t or "", 1 << 19)) for t in texts])
    return _hashed([b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" " if t else b"" for t in texts], cfg)


def _hashed(rows: list[bytes], cfg: LanguageConfig) -> np.ndarray:
    b = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    out = np.zeros(len(rows) * cfg.dims, np.float32)
    shift = np.uint64(64 - cfg.dims.bit_length() + 1)
    for n in cfg.sizes:
        if len(b) < n:
            continue
        last = len(b) - n + 1
        h = np.full(last, n, np.uint64)
        for k in range(n):
            h = (h + b[k : k + last] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        inside = doc[:last] == doc[n - 1 :]
        key = doc[:last] * cfg.dims + ((h * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)
        out += np.bincount(key[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(len(rows), cfg.dims)


def _chunks(texts: list[str | None], n: int = 128) -> Iterator[list[str | None]]:
    for s in range(0, len(texts), n):
        yield texts[s : s + n]


@dataclass
class LanguageModel:
    cfg: LanguageConfig
    idf: np.ndarray
    languages: list[str]
    vectors: np.ndarray  # [centroids, dims], rows of unit length
    owner: np.ndarray  # language of each centroid
    limits: np.ndarray  # smallest accepted cosine of each language

    def unit_rows(self, texts: list[str | None]) -> np.ndarray:
        return _unit(ngram_counts(texts, self.cfg) ** self.cfg.tf_power * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, far = [], [], []
        for part in _chunks(texts):
            cosine = self.unit_rows(part) @ self.vectors.T if self.languages else np.zeros((len(part), 0))
            for t, row in zip(part, cosine, strict=True):
                if not self.languages or not _has_letter(t):
                    names.append("und"), scores.append(0.0), far.append(True)
                    continue
                best = int(row.argmax())
                lang = self.owner[best]
                names.append(self.languages[lang]), scores.append(float(min(1.0, max(0.0, row[best])))), far.append(bool(row[best] < self.limits[lang]))
        return names, scores, far


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` unit centroids of unit rows; starts are the rows farthest from those chosen before."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    first = x[[int((x @ centres[0]).argmax())]]
    while len(first) < min(k, len(x)):
        first = np.r_[first, x[[int((x @ first.T).max(axis=1).argmin())]]]
    for _ in range(rounds):
        near = (x @ first.T).argmax(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else first[j] for j in range(len(first))])
        new = _unit(new)
        if np.allclose(new, first):
            break
        first = new
    return first


def fit_languages(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the text and non-null language of rows outside the held-out fold only.

    The centroids of a language see at most ``cfg.sample`` different rows of it, those with the smallest
    hashes of id and text; rows equal in both count once there, and every time in the document
    frequencies.  Rows that repeat an id with other texts are rows of their own.  A language whose
    texts have no letter is not learnt; an empty table gives a model that knows none.  The model has
    ``cfg.centroids`` vectors of ``cfg.dims`` numbers for each language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    learn = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold("doc_id", cfg.folds) != cfg.held_out))
    learn = learn.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows per dimension and, as dimension -1, in all; the smallest hashes of each language."""
        df, n = np.zeros(cfg.dims, np.int64), 0
        low: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, h = np.asarray(batch.column(0).to_pylist(), object), np.asarray(batch.column(2))
            for name in set(lang):
                seen = np.r_[low.get(name, np.empty(0, np.int64)), h[lang == name]]
                low[name] = np.unique(seen)[: cfg.sample]
            for _, texts in array_slices(batch.column(1)):
                for part in _chunks(texts):
                    df += (ngram_counts(part, cfg) > 0).sum(axis=0)
                    n += len(part)
        dims, langs = len(df) + 1, [name for name, v in low.items() for _ in v]
        columns = [pa.array([*range(cfg.dims), -1] + [None] * len(langs), pa.int32()), pa.array([*df, n] + [None] * len(langs), pa.int64())]
        columns += [pa.array([None] * dims + langs, pa.string()), pa.array([None] * dims + [int(x) for v in low.values() for x in v], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "lang", "h"])

    found = materialise(learn.mapInArrow(survey, "dim int, n long, lang string, h long"))
    df = {r.dim: r.n for r in found.where("dim is not null").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(d, 0))) + 1 for d in range(cfg.dims)], np.float32)
    # ranked in 64 parts first, so that no task ranks what all tasks have found of a language
    ranked = found.where("dim is null").select("lang", "h").distinct()
    for keys in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        ranked = ranked.withColumn("k", order).where(F.col("k") <= cfg.sample).drop("k")
    limits = materialise(ranked.groupBy("lang").agg(F.max("h").alias("most")))
    sample = learn.join(small_side(limits), "lang").where("h <= most").select("lang", "text", "h")
    shared = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of whole texts, once for equal rows: what goes to the task of a language has a fixed size."""
        done: set[tuple[str, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for first, texts in array_slices(batch.column(1)):
                new = []
                for i, t in enumerate(texts, first):
                    if keys[i] not in done and _has_letter(t):
                        done.add(keys[i])
                        new.append((i, t))
                for part in _chunks(new):
                    counts = ngram_counts([t for _, t in part], cfg)
                    at = pa.array([i for i, _ in part])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(list(counts), pa.list_(pa.float32()))], ["lang", "h", "counts"])

    def centroids(t: pa.Table) -> pa.Table:
        counts = np.array(sorted(t["counts"].to_pylist()), np.float32)  # in an order of their own
        x = _unit(counts ** cfg.tf_power * shared.value)
        c = spherical_kmeans(x, cfg.centroids)
        limit = float(np.quantile((x @ c.T).max(axis=1), cfg.rejection))
        n = len(c)
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * n), "limit": pa.array([limit] * n), "v": pa.array(list(c.astype(np.float32)), pa.list_(pa.float32()))})

    sample = sample.mapInArrow(vectors, "lang string, h long, counts array<float>").dropDuplicates(["lang", "h"])
    found = sample.groupBy("lang").applyInArrow(centroids, "lang string, limit double, v array<float>").collect()
    found = [r for _, r in sorted(enumerate(found), key=lambda x: (x[1].lang, x[0]))]  # centroids of a language stay in order
    shared.unpersist()
    names = sorted({r["lang"] for r in found})
    limits = {r["lang"]: r["limit"] for r in found}
    return LanguageModel(
        cfg, idf, names, np.array([r["v"] for r in found], np.float32).reshape(len(found), cfg.dims),
        np.array([names.index(r["lang"]) for r in found], int), np.array([limits[n] for n in names]),
    )


def identify_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct ``out_col``: ``lang``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected, as is
    every text if nothing was learnt; ties go to the first centroid in the order of languages; very
    long texts are read whole; an existing column ``out_col`` is replaced; empty tables stay empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"lang": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
    run = per_text(lambda: lambda texts: structs(kinds, list(shared.value.predict(texts))), "lang string, score double, rejected boolean")
    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))
