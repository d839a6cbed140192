"""Operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillfold.llm import chat_format, common, decontaminate, language_id, license_scan, mixing, near_dedup, quality_model, quality_rules, token_count, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000


def frame(spark, rows):
    """documents rows from ``(doc_id, text[, lang[, source]])``, with columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumn("cid", F.lit("x")).withColumn("label", F.lit(1)).withColumn("key", F.lit(None).cast("int"))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "a b c d e f"), (5, LONG), (6, "été 日本 !!"), (7, "<|im_end|>\x00")]


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    return {n: read(n) for n in ("documents", "labels", "benchmark", "conversations")}


# op1 -------------------------------------------------------------------------------------------


def test_license_matches_equal_exact_containment(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"]
    rows = [(1, f"x y {apache} z"), (2, "word " * 500 + apache), (3, "Licensed under the Apache something else, Version 2.0"), (4, "All rights reserved."), *[(i + 10, t) for i, (_, t) in enumerate(ODD)]]
    got = {r.doc_id: [(m.license, m.containment) for m in r.licenses] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got[1] == got[2] == [("Apache-2.0", 1.0)]
    assert got[3] == [] and got[4] == [("all-rights-reserved", 1.0)]
    assert all(got[i] == [] for i in range(10, 10 + len(ODD)))
    assert license_scan.scan_licenses(frame(spark, rows).limit(0)).count() == 0
    assert license_scan.scan_licenses(frame(spark, rows).withColumn("licenses", F.lit(1))).columns.count("licenses") == 1


def brute_containment(text, template, cfg):
    """The largest share of a template's shingles in any region of a text."""
    t, w = decontaminate.words_of(template), decontaminate.words_of(text)
    k = min(cfg.shingle_words, len(t))
    known = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    reach = cfg.region(len(t)) - k + 1
    return max((len(known.intersection(grams[i : i + reach])) / len(known) for i in range(len(grams))), default=0)


@pytest.mark.parametrize("block", [4_000_000, 2_000])
def test_license_scan_of_edited_copies_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    cfg = license_scan.LicenseConfig(block_bytes=block)
    made = {f"made-{i}": " ".join(f"w{x}" for x in rng.integers(0, 400, int(n))) for i, n in enumerate(np.geomspace(20, 300, 100))}
    templates = license_scan.TEMPLATES | made
    rows = []
    for i, name in enumerate(list(templates) * 2):
        w = [f"p{x}" for x in rng.integers(0, 50, int(rng.integers(0, 40)))] + templates[name].split() + ["end"] * int(rng.integers(0, 9))
        for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 25))):
            w[at] = "changed" if i % 3 else f"put in {w[at]}"
        rows.append((i, " ".join(w)))
    found = license_scan.scan_licenses(frame(spark, rows), templates, cfg).select("doc_id", "licenses").collect()
    for r in found:
        want = {n: c for n, t in templates.items() if (c := brute_containment(rows[r.doc_id][1], t, cfg)) >= cfg.containment}
        got: dict = {}
        for m in r.licenses:
            got[m.license] = max(got.get(m.license, 0), m.containment)
        assert got == pytest.approx(want), rows[r.doc_id]
    assert sum(len(r.licenses) > 0 for r in found) > 150


def test_license_bands_reach_their_guarantee():
    cfg = license_scan.LicenseConfig()
    for g in license_scan.group_templates(license_scan.TEMPLATES, cfg):
        for grams in g.sets:
            need = -(-len(grams) * 4 // 5)
            low = need / (g.span + len(grams) - need)  # a window with just enough of the template
            assert low == 1 or (1 - low) ** g.bands(cfg) <= cfg.miss
        assert g.window - g.longest + 1 >= g.step and g.longest == max(g.regions)  # every region lies inside one window


# op2 -------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, tables):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=token_count.default_model())
    tricky = [" a  b", "a ▁b c", "x" * 300, "  ", "a " * 900, "</s> <unk> <s>", "▁ ▁a", "tab\tnew\nline " * 50]
    rows = [*ODD, *[(100 + i, t) for i, t in enumerate(tricky)], *[(r.doc_id + 1000, r.text) for r in tables["documents"].limit(40).collect()]]
    counted = token_count.count_tokens(frame(spark, rows), part_chars=64).select("text", "tokens.*").collect()
    assert len(counted) == len(rows)
    for r in counted:
        assert (r.n_tokens, r.n_bytes) == (len(sp.encode(r.text or "")), len((r.text or "").encode())), r.text


# op3 -------------------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, tables):
    rows = [*ODD, (50, "a b c a b c"), (51, "a a a a"), (52, "x\nx\n \n\nx"), *[(r.doc_id + 1000, r.text) for r in tables["documents"].collect()]]
    got = quality_rules.apply_rules(frame(spark, rows), {"": [np.inf] * 4}).select("text", "rules.*").collect()
    for r in got:
        n, *rest = brute_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n) and r.kept == (not r.base_failed)


def test_cutoffs_keep_their_promise(spark):
    from math import comb

    assert quality_rules.binomial_tail(3, 40, 0.1) == pytest.approx(sum(comb(40, i) * 0.1**i * 0.9 ** (40 - i) for i in range(4)))
    rng = np.random.default_rng(3)
    words = lambda i, mark: " ".join(f"w{rng.integers(5000)}{mark if rng.random() < 0.9 else ''}" for _ in range(60)) + f" {i}"
    rows = [(i, words(i, "#" if i % 10 == 0 else ""), "en" if i % 3 else "xx") for i in range(1500)]
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(1500)] + [(None, 1), (3, None)], "doc_id long, quality int")
    cut = quality_rules.learn_cutoffs(frame(spark, rows), labels, quality_rules.RuleConfig(alpha=0.04))
    assert cut["en"][0] < 1 and cut["xx"][0] == np.inf and cut[""][0] == np.inf  # too few labels: nothing is rejected
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(frame(spark, rows), cut).select("doc_id", "rules.kept").collect()}
    assert not any(got[i] for i in range(0, 1500, 10) if i % 3) and all(got[i] for i in range(1500) if i % 10)


def test_labelled_rows_are_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = frame(spark, [(i, f"text {i}") for i in range(300)] + [(6, "again"), (None, "no id"), (9, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 600, 3)] + [(6, 1), (None, 1), (12, None)], "doc_id long, quality int")

    def rows(folds):
        with common.labelled(docs, labels, "quality", folds) as learn:
            return Counter((r.doc_id, r.text, r.label) for r in learn.select("doc_id", "text", "label").collect())

    want = {folds: rows(folds) for folds in (None, 5)}
    assert want[None][6, "again", 1] == 1 and want[None][9, None, 1] == 1 and sum(want[None].values()) == 102
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert {folds: rows(folds) for folds in (None, 5)} == want


def test_every_stratum_is_certified_by_itself(spark):
    clean, marked = "one two three four five six seven", "one# two# three# four# five# six# seven#"
    rows = [(100 * s + i, f"{marked if i % 10 == 0 else clean} {i}", f"l{s}") for s in range(69) for i in range(100)]
    labels = [(d, int(d % 10 > 0)) for d, _, _ in rows]
    small = [(20_000 + i, f"{marked} {i}", "small") for i in range(20)]  # good documents that other strata would reject
    other = [(30_000 + i, f"{marked} {i}", lang) for i, lang in enumerate(["none", None, ""])]
    table = spark.createDataFrame(labels + [(d, 1) for d, _, _ in small], "doc_id long, quality int")
    docs = frame(spark, rows + small + other)
    cfg = quality_rules.RuleConfig(alpha=0.4, min_words=5)
    cut = quality_rules.learn_cutoffs(docs, table, cfg)
    assert all(cut[f"l{s}"][0] < 1 for s in range(69)) and cut["small"] == cut["none"] == cut[""] == [np.inf] * 4
    judged = quality_rules.apply_rules(docs, cut, cfg)
    assert judged.columns == [*docs.columns, "rules"]
    got = {r.doc_id: r.kept for r in judged.select("doc_id", "rules.kept").collect()}
    assert len(got) == len(rows) + 23 and all(got[d] for d, _, _ in small + other) and all(got[d] == bool(y) for d, y in labels)


# op4 -------------------------------------------------------------------------------------------


def brute_hits(text, items, size=10):
    w = decontaminate.words_of(text)
    hit, names = set(), set()
    for name, t in items:
        for p in decontaminate.windows_of(decontaminate.words_of(t), size):
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_decontamination_equals_brute_force(spark, tables, block):
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()] + [(900, "Short item"), (901, None), (902, "."), (903, "a b a b a b a b a b a b"), (903, "one two")]
    docs = [*ODD, (60, "x short ITEM y short item"), (61, "a b " * 9), (62, items[0][1]), (63, items[3][1][:90]), (64, "one, two")]
    docs += [(r.doc_id + 1000, r.text) for r in tables["documents"].limit(60).collect()]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, docs), table, block_bytes=block).select("text", "contamination.*").collect()
    for r in found:
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == brute_hits(r.text, items)
    kept = decontaminate.drop_contaminated(frame(spark, docs), table)
    assert kept.columns == frame(spark, docs).columns and kept.count() == sum(not r["items"] for r in found)


# op5 -------------------------------------------------------------------------------------------


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w, full = {s: weights[i % 3] for i, s in enumerate(names)}, set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 400)), "en", "hot" if i % 3 == 0 else ["a", "b", "Ä", None, "c"][i % 5]) for i in range(3000)]
    rows += [(5000, "tiny words", "en", "tiny"), (5001, None, "en", "void"), (5002, "", "en", "a"), (1, rows[1][1], "en", rows[1][3])]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
    for r in got:
        assert r.target == pytest.approx(water_fill(sizes)[r.source], rel=1e-9)
        if sizes[r.source] > 1000:
            assert taken[r.source] == pytest.approx(r.target, rel=0.01)
    mixed = mixing.take_mix(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    times = Counter({(r.doc_id, r.source, r["size"]): r.copies for r in got if r.copies})
    twice = Counter((r.doc_id, r.source, r["size"]) for r in got)
    taken_rows = lambda df: Counter((r.doc_id, r.source, len((r.text or "").split())) for r in df.collect())
    assert taken_rows(mixed) == {k: n * twice[k] for k, n in times.items()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert taken_rows(mixing.take_mix(docs)) == taken_rows(mixed)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    x, c, p = rng.integers(1, 500, 300).astype(float), np.ones(300), np.full(300, 0.37)
    q = np.array(mixing._fly(x.tolist(), c.tolist(), p.tolist(), rng))
    assert q @ x == pytest.approx(p @ x) and q.sum() == pytest.approx(p.sum()) and ((q > 0) & (q < 1)).sum() <= 2


def test_landing_is_the_best_of_all_ways():
    from itertools import product

    rng = np.random.default_rng(7)
    for _ in range(20):
        x, p = rng.integers(1, 900, 10).astype(float), rng.uniform(0.05, 0.95, 10)
        got = np.array(mixing._land(x.tolist(), [1.0] * 10, p.tolist()))
        cost = lambda q: abs((q - p) @ x) / max(1.0, x.mean()) + 0.01 * abs((q - p).sum())
        assert set(got) <= {0.0, 1.0} and cost(got) == pytest.approx(min(cost(np.array(q, float)) for q in product((0, 1), repeat=10)))


# op6 -------------------------------------------------------------------------------------------


def test_language_id(spark, tables):
    docs = tables["documents"]
    model = language_id.fit_languages(docs)
    held = language_id.identify_languages(docs.where(common.crc_fold("doc_id", 4) == 2), model)
    got = held.select("lang", "language.lang", "language.score").collect()
    assert len(got) > 30 and np.mean([r[0] == r[1] for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.text): r.language for r in language_id.identify_languages(frame(spark, ODD), model).collect()}
    assert all(odd[k].lang == "und" and odd[k].score == 0 for k in [(1, None), (2, ""), (3, " \n\t ")])
    assert odd[(6, "été 日本 !!")].lang in model.languages
    empty = language_id.fit_languages(docs.limit(0))
    assert {r.language.lang for r in language_id.identify_languages(docs.limit(3), empty).collect()} == {"und"}


def test_languages_learn_from_whole_texts(spark):
    head, tail = "abab baba " * 25_000, "xyxy yxyx " * 50_000  # the language shows after 250,000 characters
    rows = [(i, head + (tail if i % 2 else "klkl lklk " * 50_000), "xx" if i % 2 else "kk") for i in range(12)]
    docs = frame(spark, rows)
    model = language_id.fit_languages(docs)
    assert model.predict(["xyxy yxyx xyxy", "klkl lklk klkl"])[0] == ["xx", "kk"]
    n = language_id.ngram_counts([rows[1][1]], model.cfg)
    centre = model.vectors[model.owner == model.languages.index("xx")]
    assert np.allclose(centre @ language_id._unit(n * model.idf).T, 1, atol=1e-4)


def test_language_id_equals_brute_force(spark, tables):
    """TF-IDF and the nearest centroid over dictionaries of bytes; the centroids come from the model."""
    docs = tables["documents"].limit(50)
    cfg = language_id.LanguageConfig(dims=1 << 16)  # wide enough that few n-grams share a dimension
    model = language_id.fit_languages(docs, cfg)
    rows = [r for r in docs.withColumn("held", common.crc_fold("doc_id", 4) == 2).collect() if r.text]

    def grams(text):
        b = b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())) + b" "
        return Counter(b[i : i + n] for n in cfg.sizes for i in range(len(b) - n + 1))

    learn = [grams(r.text) for r in rows if not r.held]
    df = Counter(g for c in learn for g in c)
    idf = lambda g: np.log((1 + len(learn)) / (1 + df[g])) + 1
    place = {g: int(np.argmax(language_id._hashed([g], language_id.LanguageConfig(sizes=(len(g),), dims=cfg.dims)))) for r in rows for g in grams(r.text)}
    shared = len(place) - len(set(place.values()))
    assert shared < 0.1 * len(place)
    for r in rows[:20]:
        v = np.zeros(cfg.dims)
        for g, n in grams(r.text).items():
            v[place[g]] += n * idf(g)
        cosine = model.vectors @ (v / np.linalg.norm(v))
        name, score, _ = (x[0] for x in model.predict([r.text]))
        assert name == model.languages[model.owner[int(cosine.argmax())]] and score == pytest.approx(cosine.max(), abs=0.02)


def test_language_sample_is_bounded_by_rows(spark):
    rows = [(1, f"abab baba ab{i}", "xx") for i in range(900)] + [(i, "kiki lolo", "kk") for i in range(10, 40)] + [(8, "same words", "zz")] * 50
    docs = frame(spark, rows)
    model = language_id.fit_languages(docs, language_id.LanguageConfig(sample=20))
    assert model.languages == ["kk", "xx", "zz"]  # a repeated id starves nothing
    assert model.predict(["abab baba", "kiki", "same words", None])[0] == ["xx", "kk", "zz", "und"]


# op7, op10 -------------------------------------------------------------------------------------


def planted(rng):
    words = lambda n: [f"{''.join(rng.choice(list('aeioulnrst'), 6))}" for _ in range(n)]
    rows, labels = [], []
    for i in range(500):
        w, bad = words(80), i % 5 == 1
        for _ in range(4 * bad):
            w.insert(int(rng.integers(80)), "zwikkenoff" if i % 2 else "bbrat")
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_planted_words(spark):
    rows, labels = planted(np.random.default_rng(5))
    table = spark.createDataFrame([*labels, (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, *[(1000 + k, t) for k, (_, t) in enumerate(ODD)]])
    model = toxicity.fit_toxicity(docs, table)
    scored = toxicity.score_toxicity(docs, model).withColumn("held", common.crc_fold("doc_id", 5) == 0).collect()
    got = {r.doc_id: r.toxicity for r in scored}
    assert all(0 <= v <= 1 for v in got.values()) and {got[1000], got[1001], got[1002]} == {model.prior}
    truth = dict(labels)
    right = [(r.toxicity >= 0.5) == bool(truth[r.doc_id]) for r in scored if r.held and r.doc_id in truth]
    assert len(right) > 60 and np.mean(right) > 0.95
    model.small = False  # the way for tables that are not broadcast
    joined = {(r.doc_id, r.text): r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    assert joined == pytest.approx({(r.doc_id, r.text): r.toxicity for r in scored}, abs=1e-9)
    assert toxicity.score_toxicity(docs, model).columns == [*docs.columns, "toxicity"]
    none = toxicity.fit_toxicity(docs.limit(0), table)
    assert {r.toxicity for r in toxicity.score_toxicity(docs.limit(5), none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def brute_kneser_ney(texts, labels, cfg):
    """Log-likelihood ratio of a word, written from the formulas over dictionaries."""
    top = [Counter(), Counter()]
    for t, y in zip(texts, labels, strict=True):
        for w in toxicity._LETTERS.findall(t.lower()):
            w = b" " + w.encode() + b" "
            for j in range(1, len(w)):
                top[y][w[max(0, j - cfg.order + 1) : j + 1]] += 1
    before: dict = {}  # n-gram -> distinct bytes before it
    todo = set(top[0] | top[1])
    for m in range(cfg.order, 1, -1):
        for g in [g for g in todo if len(g) == m]:
            before.setdefault(g[1:], set()).add(g[:1])
            todo.add(g[1:])
    after: dict = {}
    for g in before:
        after.setdefault(g[:-1], {})[g[-1:]] = len(before[g])

    def discounted(followers, x, lower):
        rest = cfg.discount * len(followers) * lower
        return (max(followers.get(x, 0) - cfg.discount, 0) + rest) / sum(followers.values())

    def continuation(h, x):
        lower = continuation(h[1:], x) if h else 1 / 256
        return discounted(after[h], x, lower) if h in after else lower

    def ratio(word):
        w, out = b" " + word.encode() + b" ", 0.0
        for j in range(1, len(w)):
            h, x = w[max(0, j - cfg.order + 1) : j], w[j : j + 1]
            own = [{g[-1:]: n for g, n in c.items() if g[:-1] == h} for c in top]
            both = {k: own[0].get(k, 0) + own[1].get(k, 0) for k in own[0] | own[1]}
            shared = discounted(both, x, continuation(h[1:], x)) if both else continuation(h[1:], x)
            p = []
            for c in own:
                kept = {k: max(n - cfg.class_discount, 0) for k, n in c.items()}
                total = sum(c.values())
                p.append((kept.get(x, 0) + (total - sum(kept.values()) + cfg.strength) * shared) / (total + cfg.strength))
            out += np.log(p[1] / p[0])
        return out

    return ratio


def test_toxicity_equals_brute_force_kneser_ney(spark):
    cfg = toxicity.ToxicityConfig(class_discount=1.5, strength=3.0, calibration_rows=10)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["ab", "abba", "bräuten", "cd"][k] + "xyz"[rng.integers(3)] * int(rng.integers(3)) for k in rng.integers(0, 4, 6)) + (" zwikken bbrat" if i % 2 else "")) for i in range(60)]
    table = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, table, cfg)
    learn = {r.doc_id for r in docs.where(common.crc_fold("doc_id", cfg.folds) != 0).collect()}
    ratio = brute_kneser_ney([t for i, t in rows if i in learn], [i % 2 for i, _ in rows if i in learn], cfg)  # every labelled learning row
    words = ["zwikken", "zwikkelig", "abba", "abbat", "bräuten", "q", "xyzzy", "cdx", "b"]
    local = toxicity._Local(cfg, toxicity._Table.of(model.grams), toxicity._Table.of(model.unseen))
    assert local.word_ratios(words) == pytest.approx([ratio(w) for w in words], abs=1e-6)
    for t in [rows[1][1], "abba zwikken q", "zwikken " * 50]:
        w = t.split()
        want = sum(max(ratio(x) - cfg.margin, 0) for x in w) / np.sqrt(len(w))
        assert local.evidence([t, ""])[0] == pytest.approx(want, abs=1e-6)


def test_quality_scores_on_held_out_rows(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    model = quality_model.fit_quality(docs, labels)
    held = docs.where(common.crc_fold("doc_id", 5) == 0)
    rows = quality_model.score_quality(held, model).join(labels, "doc_id").where("quality is not null").collect()
    assert len(rows) >= 10 and np.mean([(r.quality_score >= 0.3) == bool(r.quality) for r in rows]) >= 0.9
    absent = spark.range(10_000_000, 10_100_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    more = quality_model.fit_quality(docs, labels.unionByName(absent))  # labels without documents take no place
    assert np.array_equal(more.leaf, model.leaf) and np.array_equal(more.cut, model.cut)
    assert quality_model.score_quality(docs.limit(0), model).count() == 0
    odd = quality_model.score_quality(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.quality_score <= 1 for r in odd)
    assert {r.quality_score for r in quality_model.score_quality(docs, quality_model.fit_quality(docs.limit(0), labels)).limit(3).collect()} == {0.5}


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.1)).astype(float)
    m = quality_model.fit_boosted(x, y)
    assert ((m.scores(x) >= 0.5) == (y == 1)).mean() > 0.97
    for row in x[:20]:
        raw = m.start
        for f, c, leaf in zip(m.feature, m.cut, m.leaf, strict=True):
            n = 0
            while n < len(f):
                n = 2 * n + (2 if row[f[n]] > c[n] else 1)
            raw += leaf[n - len(f)]
        assert 1 / (1 + np.exp(-raw)) == pytest.approx(m.scores(row[None])[0])


def test_very_long_texts_go_in_pieces():
    text = ("lorem ipsum " * 3 + "dolor\n") * 60_000
    assert "".join(common.pieces(text, 1000)) == text and max(map(len, common.pieces(text, 1000))) <= 1000
    assert list(common.pieces("x" * 25, 10)) == ["x" * 10, "x" * 10, "x" * 5]
    keys = np.unique(toxicity._positions(["lorem", "ipsum", "dolor"], toxicity.ToxicityConfig())[0] << np.uint64(8) | np.uint64(109))
    table = toxicity._Table(keys, np.full(len(keys), 2.0), toxicity._slots(keys))
    model = toxicity._Local(toxicity.ToxicityConfig(), table, toxicity._Table(keys, np.zeros(len(keys)), toxicity._slots(keys)))
    total, number = model._sums([text])
    assert number[0] == len(text.split()) and model.evidence([text])[0] == pytest.approx(total[0] / np.sqrt(number[0])) and total[0] > 0
    n = language_id.ngram_counts([text, "lorem"], language_id.LanguageConfig(sizes=(2, 3)))
    assert n.shape[0] == 2 and n[0].sum() > 2_000_000


# op8 -------------------------------------------------------------------------------------------


def test_chat_round_trip(spark, tables):
    nasty = ["<|im_end|>\n", "<\\|im_sep|>", "<<||>", "\\", "", None, "a\n<|im_start|>assistant\nx", "<|nl|>", "<"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", n) for n in nasty] + [("assistant", n) for n in nasty] + [("we\nird<|", "x"), (None, "y")])]
    rows += [(2, None, "user", "late"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (3, 0, "assistant", "only"), (3, 0, "assistant", "only"), (None, 0, "user", "z")]
    rows += [(-2, 1, "user", x) for x in ("<|b", "<]b", "<|")] + [(-3, 1, r, "t") for r in ("us|", "us<|", "us<]")]  # ties that escaping would order otherwise
    rows += [tuple(r) for r in tables["conversations"].select("conv_id", "turn", "role", "text").where("conv_id > 3").collect()]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("t", F.lit(0))
    read = chat_format.format_chat(turns).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("segments")).alias("loss"), "formatted", "segments")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in read.collect():
        want = sorted(((t if t is not None else -(10**9), ro or "", tx or "") for c, t, ro, tx in rows if c == r.conv_id), key=lambda z: z)
        got = [(t.role, t.text) for t in r.turns]
        if r.conv_id == 1:
            assert got == [(ro or "", tx or "") for c, t, ro, tx in rows if c == 1]
        else:
            assert got == [(ro, tx) for _, ro, tx in want]
        assert r.loss == "".join(tx for ro, tx in got if ro == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
    assert chat_format.format_chat(turns.limit(0)).count() == 0


# op9 -------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = near_dedup.words_of(t)
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "limit"), [(4, None), (5, None), (5, 0)])
def test_near_duplicates_equal_brute_force(spark, k, limit, monkeypatch):
    if limit is not None:  # nothing may be broadcast: the ways for tables beyond the bound
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(k)
    rows, base = [], [f"w{i}" for i in rng.integers(0, 3000, 120)]
    for i in range(90):  # a large group around one text, with pairs on both sides of the threshold
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 7))):
            w[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(200 + i, f"{passage} " + " ".join(f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(4, 40))))) for i in range(40)]
    rows += [(300 + i, "same text for all of them here") for i in range(30)] + [(400, "Same TEXT for all of them here"), (401, "a"), (402, "A"), (403, "b"), (404, ""), (405, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), near_dedup.NearDup(shingle_words=k)).collect()}
    want = brute_components(rows, k, 80)
    assert got == want
    kept = near_dedup.drop_near_duplicates(frame(spark, rows), near_dedup.NearDup(shingle_words=k))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_pivot_pairs_of_a_group_without_a_core(spark):
    rng = np.random.default_rng(5)
    sets, comps = {}, {}
    for family in range(8):  # no shingle is in more than 3 of 24 sets
        own = rng.integers(0, 2**62, 40)
        for k in range(3):
            cid = 10 * family + k
            sets[cid], comps[cid] = sorted({*own[k * 2 :].tolist(), *rng.integers(0, 2**62, k).tolist()}), cid
    comps[1] = 0  # already linked, so not tried again
    rest = spark.createDataFrame([(7, c, comps[c]) for c in sets], "mid long, cid long, comp long")
    held = spark.createDataFrame(list(sets.items()), "cid long, grams array<long>")
    got = {(r.a, r.b) for r in near_dedup._pivot_pairs(rest, held, 80).collect()}
    linked = {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert linked - {(0, 1)} <= got and len(linked) == 24
    assert all(a // 10 == b // 10 for a, b in got)


def test_near_duplicates_odd_rows(spark):
    got = near_dedup.near_duplicates(frame(spark, [*ODD, (None, "a b c d e f"), (9, "a b c d e f")])).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert r.component_id == r.doc_id and r.kept
    kept = near_dedup.drop_near_duplicates(frame(spark, ODD))
    assert Counter(r.doc_id for r in kept.collect())[4] == 1 and kept.columns == frame(spark, ODD).columns
    assert near_dedup.near_duplicates(frame(spark, ODD).limit(0)).count() == 0


def test_recall_of_near_copies_above_the_threshold(spark):
    """Copies with one to twelve changed words of 200; every pair that is similar enough must meet."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(150):
        w = [f"g{g}w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((2 * g, " ".join(w)))
        for at in rng.choice(200, 1 + g % 12, replace=False):
            w[at] = f"new{rng.integers(10**6)}"
        rows.append((2 * g + 1, " ".join(w)))
    want = brute_components(rows, 5, 80)
    linked = [i for i, (_, c) in want.items() if c != i]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert len(linked) > 40 and np.mean([got[i] == want[i][1] for i in linked]) >= 0.99
    assert all(got[i] == i for i, (_, c) in want.items() if c == i)


# all operators ---------------------------------------------------------------------------------


def test_five_megabytes_and_clashing_columns(spark, tables):
    """One very long text whole through every operator, over columns named as the operators' results."""
    items = [(r.item_id, r.text) for r in tables["benchmark"].limit(5).collect()]
    rng = np.random.default_rng(9)
    body = " ".join(f"w{x}" for x in rng.integers(0, 100_000, 750_000))
    tail = f" {license_scan.TEMPLATES['Apache-2.0']} idiot moron {items[2][1]}"
    docs = frame(spark, [(1, body + tail), (2, body + tail), (3, "short text"), (4, None)])
    assert len(body) > 5_000_000
    names = ["licenses", "tokens", "rules", "contamination", "language", "toxicity", "quality_score", "copy", "size", "evidence", "hits", "stats"]
    clash = docs.select("*", *(F.lit("clash").alias(n) for n in names))
    labels = tables["labels"]

    def first(df, column):
        assert df.columns.count(column) == 1 and set(df.columns) == set(clash.columns)
        got = {r.doc_id: r[column] for r in df.select("doc_id", column).collect()}
        assert got[1] == got[2] and len(got) == 4
        return got[1]

    assert [m.license for m in first(license_scan.scan_licenses(clash), "licenses")] == ["Apache-2.0"]
    assert first(token_count.count_tokens(clash), "tokens").n_bytes == len(body + tail)
    rules = first(quality_rules.apply_rules(clash, quality_rules.Cutoffs()), "rules")
    assert (rules.n_words, rules.n_repeat_words) == (brute_statistics(body + tail)[0], brute_statistics(body + tail)[4])
    seen = first(decontaminate.find_contamination(clash, spark.createDataFrame(items, "item_id long, text string")), "contamination")
    assert seen["items"] == [str(items[2][0])] and seen.spans[-1].end == seen.n_words
    assert first(language_id.identify_languages(clash, language_id.fit_languages(tables["documents"])), "language").lang != "und"
    assert 0 <= first(toxicity.score_toxicity(clash, toxicity.fit_toxicity(tables["documents"], labels)), "toxicity") <= 1
    assert 0 <= first(quality_model.score_quality(clash, quality_model.fit_quality(tables["documents"], labels)), "quality_score") <= 1
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(clash).collect()} == {1, 3, 4}
    assert {r["size"] for r in mixing.mix(clash).collect()} == {len((body + tail).split()), 2, 0}
    chat = clash.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", "size")
    turns = chat_format.format_chat(chat).select(chat_format.read_turns(F.col("formatted")).alias("t")).first().t
    assert [t.text for t in turns] == [body + tail, body + tail, "short text", ""]


# pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tables):
    docs = tables["documents"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "decontaminate", "mix_sources"]
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        rows = {r.doc_id: r.text for r in before.collect()}
        kept = [r.doc_id for r in after.collect()]
        if name != "mix_sources":
            assert after.columns == docs.columns and len(kept) == len(set(kept)) and set(kept) <= set(rows)
        if name == "near_dedup":
            assert set(kept) == {c for _, c in brute_components(list(rows.items()), 5, 80).values()}
        if name == "decontaminate":
            assert set(kept) == {i for i, t in rows.items() if not brute_hits(t, items)[1]}
        if name == "mix_sources":
            words = {i: brute_statistics(t)[0] for i, t in rows.items()}
            assert sum(words[i] for i in kept) == pytest.approx(sum(words.values()), rel=0.05) and max(Counter(kept).values()) <= 3
        else:
            before = spark.createDataFrame(after.collect(), docs.schema)


def test_queries_hash_what_they_say(spark):
    from quillfold.llm.queries import QUERIES

    rows = {r.conv_id: r for r in QUERIES["op8_chat_formatting"](spark, SF).collect()}
    trap = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(trap)
    assert rows[-1].loss_sha256 == hashlib.sha256(trap.encode()).hexdigest()
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{trap}\nassistant\n{trap}\n".encode()).hexdigest()


def test_empty_tables(spark, tables):
    none, docs = frame(spark, ODD).limit(0), frame(spark, ODD)
    labels, items = tables["labels"].limit(0), tables["benchmark"].limit(0)
    assert set(map(tuple, quality_rules.learn_cutoffs(docs, labels).values())) == {(np.inf,) * 4}
    assert quality_rules.drop_low_quality(none, tables["labels"]).count() == 0
    assert decontaminate.drop_contaminated(docs, items).count() == len(ODD)
    assert decontaminate.find_contamination(none, tables["benchmark"]).count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == len(ODD)
    assert token_count.count_tokens(none).count() == 0 and mixing.take_mix(none).count() == 0
    assert near_dedup.drop_near_duplicates(none).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, tables["documents"].limit(0), SF).count() == 0, name
