"""Benchmark decontamination: Wu-Manber search for word windows of test items in documents.

The test items travel to the executors in blocks of bounded size, one at a time.  While one block
holds them all, each document is read once, in place: no shuffle and no join.  With more blocks the
documents are read once for each, and the few texts with hits are joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import materialise, per_text, small_side, spare_name, structs

#: Bytes that stay in words: digits, letters and all of non-ASCII; A-Z become a-z, the rest blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The same words as a pattern, in any case.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter, non-empty list is one window."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class WuManber:
    """Wu-Manber tables over words for patterns of one length ``m``.

    A block is the last two words of a position (one for ``m = 1``).  ``shift`` says how far the
    search may move on when it sees a block; blocks that end a pattern shift by 0 and have a bucket,
    whose patterns are compared in full.
    """

    def __init__(self, m: int) -> None:
        self.m, self.b = m, min(2, m)
        self.far = m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}

    def add(self, pattern: tuple[bytes, ...], item: str) -> None:
        for end in range(self.b, self.m + 1):
            block = pattern[end - self.b : end]
            self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
        self.bucket.setdefault(pattern[self.m - self.b :], {}).setdefault(pattern, set()).add(item)

    def find(self, words: list[bytes]) -> Iterable[tuple[int, set[str]]]:
        """``(start, items)`` of every occurrence."""
        m, b, far, shift = self.m, self.b, self.far, self.shift
        at, n = m, len(words)
        while at <= n:
            block = tuple(words[at - b : at])
            step = shift.get(block, far)
            if step:
                at += step
                continue
            items = self.bucket[block].get(tuple(words[at - m : at]))
            if items:
                yield at - m, items
            at += 1


def build_tables(rows: list[tuple[str, str]], window: int) -> list[WuManber]:
    tables: dict[int, WuManber] = {}
    for item, text in rows:
        for w in windows_of(words_of(text), window):
            tables.setdefault(len(w), WuManber(len(w))).add(w, item)
    return list(tables.values())


def _merged(starts: list[tuple[int, int]]) -> list[dict[str, int]]:
    spans: list[dict[str, int]] = []
    for a, b in sorted(starts):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"start": a, "end": b})
    return spans


_KINDS = {"spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string())}
_TYPE = "spans array<struct<start:long,end:long>>, items array<string>"


def _chunks(rows: DataFrame, n: int, window: int, block_bytes: int) -> DataFrame:
    """``item, text, at``: items dealt to ``n`` blocks, long ones in overlapping chunks first."""
    long_words = max(2 * window, block_bytes // 64)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text)
                parts = [w[i : i + long_words + window - 1] for i in range(0, max(1, len(w) - window + 1), long_words)]
                if w:
                    texts = [b" ".join(p).decode("utf-8", "replace") for p in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts)), pa.array(texts)], ["item", "text"])

    return materialise(rows.mapInArrow(cut, "item string, text string").withColumn("at", F.pmod(F.xxhash64("item", "text"), F.lit(n))))


def _scan(shared, window: int):
    """From texts to spans, items and the number of words, with tables built once per task from a broadcast block."""

    def make():
        tables = build_tables(shared.value, window)

        def scan(texts: list[str | None]) -> pa.Array:
            hits: list[list[tuple[int, int]]] = [[] for _ in texts]
            names: list[set[str]] = [set() for _ in texts]
            counts = []
            for found, seen, text in zip(hits, names, texts, strict=True):
                words = words_of(text)
                counts.append(len(words))
                for t in tables:
                    for start, ids in t.find(words):
                        found.append((start, start + t.m))
                        seen.update(ids)
            return structs(_KINDS | {"n_words": pa.int64()}, [[_merged(h) for h in hits], [sorted(s) for s in names], counts])

        return scan

    return per_text(make, f"{_TYPE}, n_words long")


def _united(rows: DataFrame) -> DataFrame:
    """``k1, k2, spans, items`` of texts, from at most one row of each text and block."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged([(s["start"], s["end"]) for part in parts for s in part]) for parts in batch.column(2).to_pylist()]
            items = [sorted({i for part in parts for i in part}) for parts in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip((spans, items), _KINDS.values(), strict=True))], ["k1", "k2", *_KINDS])

    by_text = rows.groupBy("k1", "k2").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return by_text.mapInArrow(unite, f"k1 long, k2 long, {_TYPE}")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 2_000_000,
    out_col: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct column ``out_col``: ``n_words``, ``spans`` and ``items``.

    ``spans`` are the merged word ranges (``end`` exclusive) covered by occurrences of item
    windows; ``items`` the ids with an occurring window, as sorted strings.  Words are runs of
    digits, letters and non-ASCII characters, A-Z lower-cased.

    Defined cases: a null or wordless text has no words and no hits; an item without words never
    occurs; an item shorter than ``window`` is one window; rows with equal item ids are one item; a
    null item id is listed as ``null``; repeated documents each have their row; an existing column
    named ``out_col`` is replaced; very long texts are searched whole; empty tables give no hits or no
    rows.
    """
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    rows = items.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    if n == 1:
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in rows.collect()])
        hits = spare_name([*docs.columns, out_col], "hits")
        found = docs.withColumn(hits, _scan(shared, window)(text))
        return found.withColumn(out_col, F.struct(*(F.col(hits)[c].alias(c) for c in ("n_words", "spans", "items")))).drop(hits)

    n_words = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    chunks = _chunks(rows, n, window, block_bytes)
    key = {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}
    keyed = docs.where(text.isNotNull()).select(*(k.alias(c) for c, k in key.items()), text.alias("text"))
    parts = []
    for k in range(n):
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in chunks.where(F.col("at") == k).collect()])
        seen = keyed.select("k1", "k2", _scan(shared, window)(F.col("text")).alias("h")).where(F.size("h.items") > 0)
        parts.append(materialise(seen.select("k1", "k2", "h.spans", "h.items").dropDuplicates(["k1", "k2"])))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    names = {c: spare_name([*docs.columns, out_col], f"hits_{c}") for c in ("k1", "k2", *_KINDS)}
    united = materialise(_united(every)).withColumnsRenamed(names)
    found = docs.withColumns({names[c]: k for c, k in key.items()}).join(small_side(united), [names["k1"], names["k2"]], "left")
    none = [F.coalesce(names[c], F.array().cast(t)).alias(c) for c, t in zip(_KINDS, ("array<struct<start:long,end:long>>", "array<string>"), strict=True)]
    out = found.withColumn(out_col, F.struct(n_words.alias("n_words"), *none))
    return out.select(*(F.col(c) for c in docs.columns if c.lower() != out_col.lower()), out_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs, columns unchanged."""
    name = spare_name(docs.columns, "contamination")
    seen = find_contamination(docs, items, out_col=name, **settings)
    return seen.where(F.size(F.col(f"{name}.items")) == 0).select(*docs.columns)
