"""Language identification, source divergence and ranked search, against brute force and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import divergence, language, search

DOCS = "doc_id bigint, text string, lang string, source string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- source divergence -----------------------------------------------------------------------------


def audited(rows, least, top):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, held, groups = defaultdict(Counter), defaultdict(Counter), sorted({r[1:] for r in rows})
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        count[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        all_of = Counter()
        for g in groups:
            if g[0] == lang:
                all_of.update(count[g])

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own, q = p(count[lang, source]), p(all_of)
        pairs = [(sum(abs(own[t] - o[t]) for t in kept), s) for la, s in groups if la == lang and s != source for o in [p(count[la, s])]]
        terms = [(own[t] - q[t], t) for t in kept if count[lang, source][t] and own[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                out.append((lang, source, part, item, v, k + 1))
    return sorted(out)


@pytest.mark.parametrize("top,open_", [(50, 512), (3, 2)])
def test_audit(spark, messy, monkeypatch, top, open_):
    monkeypatch.setattr(divergence, "OPEN", open_)
    monkeypatch.setattr(divergence, "GROWTH", 2)
    monkeypatch.setattr(divergence, "CELLS", 16)
    monkeypatch.setattr(divergence, "TABLE", 50)
    rng = random.Random(3)
    more = [(" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["en", "xx", None]), f"s{rng.randint(0, 4)}") for _ in range(200)]
    docs = messy.select("doc_id", "text", "lang", "source", "n_words").unionByName(spark.createDataFrame([(k, *r, "x") for k, r in enumerate(more)], DOCS + ", n_words string"))
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(map(tuple, divergence.audit(docs, 4, top).collect())) == audited(rows, 4, top)


def test_audit_keeps_buckets_closed(spark, monkeypatch):
    """Best first: with a clear winner the rare terms are never opened, and ties at the last place are."""
    opened = []
    real = divergence.materialise

    def seen(df):
        t = real(df)
        if t.columns == ["lang", "source", "bucket"]:
            opened.append(t.count())
        return t

    monkeypatch.setattr(divergence, "materialise", seen)
    monkeypatch.setattr(divergence, "OPEN", 1)
    rows = [("hot " * 50 + "warm " * 20, "en", "a")] * 5 + [("x y z u v w " * (1 + k % 3), "en", "b") for k in range(40)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], DOCS)
    got = sorted(map(tuple, divergence.audit(docs, 4, 1).collect()))
    assert got == audited(rows, 4, 1) and sum(opened) < 4


def test_audit_of_nothing(spark, nothing):
    assert divergence.audit(nothing).collect() == []
    one = spark.createDataFrame([(1, None, None, None), (2, "", None, "b"), (3, "word", "en", "a")], DOCS)
    assert sorted(map(tuple, divergence.audit(one).collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_001, 2_000_000_000)], "c bigint, n bigint, v bigint")
    c, n, v = df.first()
    assert df.select(divergence._probability(df.c, df.n, df.v)).first()[0] == 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)


# --- ranked search -----------------------------------------------------------------------------------


def ranked(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            if c:
                m = 100 - 75 + 75 * c.total() * n // total
                s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
                if s > 0:
                    scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return out


ITEMS = [(1, "w1 w2 W3 w3 é"), (2, None), (3, ""), (None, "漢字 w4"), (1, "w1 w2 W3 w3 é"), (5, "nowhere"), (6, "la la w9"), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 it")]


@pytest.mark.parametrize("sizes", [{}, {"shard_terms": 3}, {"shard_items": 2}])
def test_search(spark, messy, monkeypatch, sizes):
    monkeypatch.setattr(search, "BLOCK", 40)
    items = spark.createDataFrame([(*x, "r") for x in ITEMS], "item_id bigint, text string, rank string")
    got = [tuple(r) for r in search.search(messy, items, 4, **sizes).select("item_id", "rank", "doc_id", "score").collect()]
    want = ranked([(r.doc_id, r.text) for r in messy.collect()], ITEMS, 4)
    assert Counter(got) == Counter(want) and len(want) > 12


def test_search_of_nothing(spark, messy, nothing):
    items = spark.createDataFrame([("a", "w1 w2"), ("b", None)], "item_id string, text string")
    assert search.search(nothing, items).collect() == []
    assert search.search(messy, items.limit(0)).collect() == []
    assert {r.item_id for r in search.search(messy, items).collect()} == {"a"}


def test_best_keeps_ties_of_lesser_documents():
    best = search._Best(2, 1)
    for doc in (9, 5, 7, 3):
        best.take(np.zeros(1, np.int64), np.array([4]), np.array([doc]))
    best.take(np.zeros(1, np.int64), np.array([0]), np.array([1]))
    assert sorted(best.rows()) == [(0, 4, 3), (0, 4, 5)]


# --- language identification ---------------------------------------------------------------------------

WORDS = {"en": "the of and house water through night small where which", "fr": "le être été maison eau petit où nuit très français", "de": "der über haus wasser klein straße nacht weiß durch größer"}


def prose(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = [(k, prose(la, rng.randint(3, 60), rng), la, "s") for k in range(300) for la in [rng.choice(list(WORDS))]]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def test_held_out(labelled):
    rows, docs = labelled
    found = {r.doc_id: r for r in language.predict(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {k for k, r in found.items() if r.held_out} == {r[0] for r in held}
    assert sum(found[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_what_is_held_out_mean_nothing(spark, labelled):
    rows, docs = labelled
    wrong = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else la, "t") for i, t, la, _ in rows], DOCS).repartition(3)
    said = lambda df: {(r.doc_id, r.lang_pred) for r in language.predict(df).collect()}
    assert said(wrong) == said(docs)


def test_mixtures(spark, labelled):
    rng = random.Random(9)
    model = language.fit(labelled[1])
    mixed = [prose("en", 60, rng) + " " + prose("fr", 30, rng), prose("de", 90, rng), prose("en", 40, rng) + " " + prose("fr", 40, rng) + " " + prose("de", 40, rng)]
    out = {r.doc_id: {x["lang"]: x["share"] for x in r.languages} for r in language.shares(spark.createDataFrame([(k, t) for k, t in enumerate(mixed)], "doc_id bigint, text string"), model).collect()}
    assert set(out[0]) == {"en", "fr"} and 0.55 < out[0]["en"] < 0.8
    assert set(out[1]) == {"de"} and set(out[2]) == {"en", "fr", "de"}


def test_shares_maximise_the_likelihood(labelled):
    """Two languages: the shares found are as good as those of a fine grid, and the second stays only if it pays its price."""
    rng = random.Random(2)
    model = language.fit(labelled[1])
    a, b = model.languages.index("en"), model.languages.index("fr")
    doc, bins, count = language.features([prose("en", 50, rng) + " " + prose("fr", 50, rng)])
    row = language.mixtures(model, doc, bins, count, 1)[0]
    like = lambda x: float((count * np.log(model.p[bins, a] * x + model.p[bins, b] * (1 - x))).sum())
    best = max(like(x) for x in np.linspace(0.001, 0.999, 999))
    assert abs(row[a] + row[b] - 1) < 1e-3 and like(float(row[a])) > best - 1 and best - max(like(1.0), like(0.0)) > language.PENALTY


def test_und(spark, messy, nothing):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 34 --\n", "en", "s"), (4, "漢字", None, "s"), (5, "The water", "en", "s"), (None, "the water", "en", None), (5, "The water", "en", "s")]
    got = language.predict(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id or 9)] == ["und", "und", "und", "en", "en", "en", "en"]
    assert language.predict(nothing).collect() == [] and language.predict(messy).count() == messy.count()
    assert {r.lang_pred for r in language.predict(messy.where("lang IS NULL")).collect()} == {"und"}


def test_long_texts_are_taken_whole(monkeypatch):
    text = "Straße 'über' die—漢字 nacht. " * 200
    whole = language.features([text])
    monkeypatch.setattr(language, "PIECE", 97)
    assert all(np.array_equal(x, y) for x, y in zip(whole, language.features([text]), strict=True))
    doc, _, count = language.features([text, "a", "", text])
    assert count[doc == 0].tolist() == count[doc == 3].tolist() and count[doc == 1].sum() == 1 and count[doc == 2].sum() == 0
