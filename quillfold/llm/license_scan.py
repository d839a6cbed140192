"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

A match is a region of a text, little longer than a template, that holds at least ``containment`` of
the template's distinct shingles.  Templates are grouped by shingle length and size.  For each group
the text is cut into windows longer than its largest region, so close together that every region lies
inside one.  A band is one minimum; the number of bands follows from the smallest similarity that a
template of the group can have with a window that holds enough of it, so that such a window is missed
with probability at most ``miss``.  Each band is a table of the templates' minima, in which the window's
minimum is looked up; the templates found are confirmed by the exact containment of the best region.
A text without any shingle of a template has no window that could meet one and is left out at once.
The text is read once, in place: no shuffle and no join.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.common import mix64, per_text, structs
from quillfold.llm.decontaminate import words_of
from quillfold.llm.license_texts import TEMPLATES


@dataclass(frozen=True)
class LicenseConfig:
    shingle_words: int = 5  # a shorter template is one shingle
    containment: float = 0.8  # share of a template's shingles that a region must hold
    slack: float = 0.125  # a region has so much more words than the template, for words put in
    miss: float = 1e-5
    block_bytes: int = 4_000_000  # templates beyond that are scanned for in several blocks
    seed: int = 7

    def region(self, words: int) -> int:
        """Words of a region for a template of so many words."""
        return words + int(words * self.slack)


@dataclass
class _Group:
    """Templates of one shingle length ``k`` whose regions have at most ``longest`` words."""

    k: int
    longest: int
    names: list[str]
    sets: list[np.ndarray]
    regions: list[int]

    @property
    def step(self) -> int:
        """Words between the starts of windows; short ones start at every word."""
        return max(1, self.longest // 8)

    @property
    def window(self) -> int:
        """Words of a window."""
        return self.longest + self.step - 1

    @property
    def span(self) -> int:
        """Shingles of a window."""
        return self.window - self.k + 1

    def bands(self, cfg: LicenseConfig) -> int:
        low = min(need / (self.span + len(s) - need) for s in self.sets for need in [math.ceil(cfg.containment * len(s))])
        return math.ceil(math.log(cfg.miss) / math.log(1 - low)) if low < 1 else 1


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _grams(w: np.ndarray, k: int) -> np.ndarray:
    g = np.full(max(0, len(w) - k + 1), k, np.uint64)
    for j in range(k):
        g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(g)])
    return g


def group_templates(templates: dict[str, str], cfg: LicenseConfig) -> list[_Group]:
    """Groups in which the largest template has at most five quarters of the words of the smallest."""
    sized = sorted((len(w), n, w) for n, t in templates.items() if (w := words_of(t)))
    groups: list[_Group] = []
    smallest = 0
    for n, name, w in sized:
        k = min(cfg.shingle_words, n)
        if not groups or groups[-1].k != k or 4 * n > 5 * smallest:
            groups.append(_Group(k, 0, [], [], []))
            smallest = n
        g = groups[-1]
        g.longest = cfg.region(n)
        g.names.append(name), g.regions.append(cfg.region(n)), g.sets.append(np.unique(_grams(_hashes(w), k)))
    return groups


class _Scanner:
    def __init__(self, templates: dict[str, str], cfg: LicenseConfig) -> None:
        self.cfg, self.groups = cfg, group_templates(templates, cfg)
        rng = np.random.default_rng(cfg.seed)
        most = max((g.bands(cfg) for g in self.groups), default=0)
        self.a = rng.integers(0, 2**63, most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, most, dtype=np.uint64)
        self.tables = [[self._band(g, j) for j in range(g.bands(cfg))] for g in self.groups]
        #: shingles of each group, and of all groups of a shingle length as a bit for each upper part of a hash
        self.known = [np.unique(np.concatenate(g.sets)) for g in self.groups]
        self.seen = {g.k: np.zeros(1 << 20, bool) for g in self.groups}
        for g, known in zip(self.groups, self.known, strict=True):
            self.seen[g.k][known >> np.uint64(44)] = True

    def _minima(self, grams: np.ndarray, j: int) -> np.ndarray:
        return (grams * self.a[j] + self.b[j]) >> np.uint64(32)

    def _band(self, group: _Group, j: int) -> tuple[np.ndarray, list[list[int]]]:
        """Table of band ``j``: sorted minima, and the templates that have each."""
        by_value: dict[int, list[int]] = defaultdict(list)
        for t, s in enumerate(group.sets):
            by_value[int(self._minima(s, j).min())].append(t)
        values = sorted(by_value)
        return np.array(values, np.uint64), [by_value[v] for v in values]

    def _retrieved(self, group: _Group, tables: list, grams: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """``(window, template)`` that meet in a band."""
        met: set[tuple[int, int]] = set()
        for s in range(0, len(starts), 1 << 14):
            first = starts[s : s + (1 << 14)]
            at = np.minimum(first[:, None] + np.arange(group.span), len(grams) - 1)
            for j, (values, holders) in enumerate(tables):
                least = self._minima(grams, j)[at].min(axis=1)
                place = np.minimum(np.searchsorted(values, least), len(values) - 1)
                for i in np.flatnonzero(values[place] == least):
                    met.update((s + int(i), t) for t in holders[place[i]])
        return met

    def _best(self, group: _Group, t: int, grams: np.ndarray, low: int, high: int) -> tuple[float, int]:
        """The largest containment of template ``t`` in a region of shingles ``low`` to ``high``, and its start."""
        found = np.searchsorted(group.sets[t], grams[low:high])
        there = np.flatnonzero(group.sets[t][np.minimum(found, len(group.sets[t]) - 1)] == grams[low:high])
        reach, inside, best, left = group.regions[t] - group.k + 1, defaultdict(int), (0, 0), 0
        for at in there.tolist():  # the region that ends with each hit
            inside[int(found[at])] += 1
            while at - int(there[left]) >= reach:
                gone = int(found[there[left]])
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            best = max(best, (len(inside), -(low + int(there[left]))))
        return best[0] / len(group.sets[t]), -best[1]

    def _matches(self, group: _Group, tables: list, grams: np.ndarray, there: np.ndarray, n_words: int) -> list[dict]:
        """Matches of a group in one text; ``there`` marks the shingles that some template of it has."""
        before = np.r_[0, np.cumsum(there)]
        starts = np.arange(0, len(grams), group.step)
        starts = starts[before[np.minimum(starts + group.span, len(grams))] > before[starts]]  # others meet nothing
        out = []
        for i, t in sorted(self._retrieved(group, tables, grams, starts)):
            low = int(starts[i])
            share, start = self._best(group, t, grams, low, min(low + group.span, len(grams)))
            if share >= self.cfg.containment:
                out.append({"license": group.names[t], "start": start, "end": min(start + group.regions[t], n_words), "containment": share})
        return out

    def scan(self, texts: list[str | None]) -> list[list[dict]]:
        words = [words_of(t) for t in texts]
        out: list[list[dict]] = [[] for _ in texts]
        w = _hashes([x for ws in words for x in ws])
        ends = np.cumsum([len(ws) for ws in words]).astype(np.int64)
        for k, seen in self.seen.items():
            grams = _grams(w, k)
            hits = np.flatnonzero(seen[grams >> np.uint64(44)])
            owner = np.searchsorted(ends, hits, side="right")
            for d in np.unique(owner[hits + k <= ends[owner]]).tolist():
                own = grams[ends[d] - len(words[d]) : ends[d] - k + 1]
                for group, tables, known in zip(self.groups, self.tables, self.known, strict=True):
                    if group.k == k and (there := _among(own, known)).any():
                        out[d] += self._matches(group, tables, own, there, len(words[d]))
        return [_merged(m) for m in out]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _merged(matches: list[dict]) -> list[dict]:
    """Join overlapping regions of one license; the best containment counts."""
    out: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["license"], m["start"])):
        if out and out[-1]["license"] == m["license"] and m["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], m["end"])
            out[-1]["containment"] = max(out[-1]["containment"], m["containment"])
        else:
            out.append(dict(m))
    return out


def _blocks(templates: dict[str, str], limit: int) -> list[dict[str, str]]:
    """Templates in blocks of at most ``limit`` bytes, one template at least."""
    blocks: list[dict[str, str]] = [{}]
    size = 0
    for n, t in templates.items():
        if blocks[-1] and size + len(t.encode()) > limit:
            blocks.append({})
            size = 0
        blocks[-1][n] = t
        size += len(t.encode())
    return blocks


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, cfg: LicenseConfig = LicenseConfig(), *, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """``docs`` with ``out_col``, an array of ``license, start, end, containment``.

    ``start`` and ``end`` (exclusive) are word positions of the regions that hold at least
    ``cfg.containment`` of the template's shingles, overlapping regions of a license joined.

    Defined cases: a null or wordless text, or one shorter than a shingle, has an empty array;
    templates without words are ignored; equal templates are all reported; very long texts are
    scanned whole; repeated rows have equal results; an existing column ``out_col`` is replaced; an
    empty table stays empty.  Templates of more than ``cfg.block_bytes`` are scanned for block by
    block over slices of the texts, so that a task holds the tables of one block at a time.
    """
    blocks = _blocks(TEMPLATES if templates is None else templates, cfg.block_bytes)
    kinds = {"m": pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))}

    def make():
        kept = _Scanner(blocks[0], cfg) if len(blocks) == 1 else None

        def run(texts: list[str | None]) -> pa.Array:
            found: list[list[dict]] = [[] for _ in texts]
            for block in blocks:
                for all_, some in zip(found, (kept or _Scanner(block, cfg)).scan(texts), strict=True):
                    all_ += some
            return structs(kinds, [[sorted(f, key=lambda m: (m["license"], m["start"])) for f in found]]).field(0)

        return run

    run = per_text(make, "array<struct<license:string,start:long,end:long,containment:double>>", 1 << (20 if len(blocks) == 1 else 26))
    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))
