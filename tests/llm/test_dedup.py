"""Substring dedup and near-duplicates against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import near_duplicates, suffix_array_dedup, suffix_tree_dedup
from quarry.llm.hashing import spans_of, word_hashes
from quarry.llm.shared import NULL_ID

WORD = r"[^\x20\x09-\x0D]+"
FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def key(r):
    return NULL_ID if r.doc_id is None else r.doc_id


def bytes_removed(docs, w):
    least = {}
    for r in docs:
        t = (r.text or "").encode()
        for k in range(len(t) - w + 1):
            x = t[k : k + w]
            least[x] = min(least.get(x, NULL_ID), key(r))
    out = Counter()
    for r in docs:
        t = (r.text or "").encode()
        cov = np.zeros(len(t), bool)
        for k in range(len(t) - w + 1):
            if least[t[k : k + w]] < key(r):
                cov[k : k + w] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cov])
        spans = sum(1 for k in range(len(t)) if cov[k] and (k == 0 or not cov[k - 1]))
        out[(r.doc_id, len(t), int(cov.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def words_removed(docs, w):
    least = {}
    for r in docs:
        t = re.findall(WORD, r.text or "")
        for k in range(len(t) - w + 1):
            x = tuple(t[k : k + w])
            least[x] = min(least.get(x, (NULL_ID + 1, 0)), (key(r), k))
    out = Counter()
    for r in docs:
        t = re.findall(WORD, r.text or "")
        cov = [False] * len(t)
        for k in range(len(t) - w + 1):
            if least[tuple(t[k : k + w])] < (key(r), k):
                cov[k : k + w] = [True] * w
        kept = " ".join(x for x, c in zip(t, cov) if not c)
        out[(r.doc_id, len(t), sum(cov), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3000, "hot": 3}])
def test_suffix_array(messy, nothing, sizes):
    got = suffix_array_dedup.dedup(messy, **sizes)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got.columns == columns
    assert Counter(tuple(r) for r in got.collect()) == bytes_removed(messy.collect(), 50)
    assert suffix_array_dedup.dedup(nothing, **sizes).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3000, "hot": 3}])
def test_suffix_tree(messy, nothing, sizes):
    got = suffix_tree_dedup.dedup(messy, **sizes)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == words_removed(messy.collect(), 20)
    assert suffix_tree_dedup.dedup(nothing, **sizes).count() == 0


def test_refinements_agree():
    rng = np.random.default_rng(1)
    cells = [rng.integers(0, 2, n).astype(np.uint8) for n in rng.integers(20, 40, 300)]
    units, ends = np.concatenate(cells), np.cumsum([len(c) for c in cells])
    starts = ends - [len(c) for c in cells]
    want = [bytes(c[k : k + 20]) for c in cells for k in range(len(c) - 19)]
    for f in (suffix_array_dedup.refine, suffix_tree_dedup.grow):
        got = f(units, starts, ends, 20).tolist()
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3000, "hot": 3}])
def test_maximal_repeats(messy, nothing, sizes):
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows, least = docs.collect(), {}
    for r in rows:
        t = re.findall(WORD, r.text or "")
        for k in range(len(t) - 19):
            x = tuple(t[k : k + 20])
            least[x] = min(least.get(x, (NULL_ID, 0)), (r.doc_id, k))
    want = set()
    for r in rows:
        t, open_ = re.findall(WORD, r.text or ""), None
        for k in range(len(t) - 18):
            first = least[tuple(t[k : k + 20])] if k + 20 <= len(t) else (r.doc_id, k)
            if open_ and (first == (r.doc_id, k) or first != (open_[1], open_[2] + k - open_[0])):
                want.add((r.doc_id, open_[0], k + 19, open_[1], open_[2]))
                open_ = None
            if not open_ and first != (r.doc_id, k):
                open_ = (k, *first)
    got = [tuple(r) for r in suffix_tree_dedup.maximal(docs, **sizes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(b - a for _, a, b, _, _ in got) > 100
    assert suffix_tree_dedup.maximal(nothing, **sizes).count() == 0


def shingles(t):
    w = re.findall(FOLDED, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(docs):
    sets = [shingles(r.text) for r in docs]
    n = len(docs)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) * 5 >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i in range(n):
        least[top(i)] = min(least.get(top(i), NULL_ID), key(docs[i]))
    return Counter((docs[i].doc_id, None if (c := least[top(i)]) == NULL_ID else c, links[i]) for i in range(n))


def with_copies(spark, messy):
    base = " ".join(f"k{i}" for i in range(200))
    more = [(1000 + k, base.replace(f" k{k * 3 + 7} ", f" z{k} ")) for k in range(40)]
    more += [(1100 + k, base.replace(" k50 ", " y ").replace(f" k{150 + k} ", " y ")) for k in range(5)]
    return messy.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, messy, nothing, small, monkeypatch):
    if small:
        monkeypatch.setattr(near_duplicates, "BLOCK", 8)
        monkeypatch.setattr(near_duplicates, "BUCKET", 4)
    docs = with_copies(spark, messy)
    got = near_duplicates.classes(docs)
    assert Counter(tuple(r) for r in got.collect()) == near(docs.collect())
    assert near_duplicates.classes(nothing).count() == 0


@pytest.mark.parametrize("n", [256, 512, 1024, 4096])
def test_words_on_which_sums_of_powers_collide(spark, n):
    """A Thue-Morse word and its complement are different words."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"c{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{common} {word}"), (2, f"{common} {other}"), (3, word), (4, other)], "doc_id bigint, text string")
    assert [r.n_removed for r in suffix_tree_dedup.dedup(docs).collect()] == [0, 0, 0, 0]
    assert {(r.doc_id, r.class_id, r.n_links) for r in near_duplicates.classes(docs.where("doc_id > 2")).collect()} == {(3, 3, 0), (4, 4, 0)}
    assert near_duplicates.distinct_documents(docs.where("doc_id > 2")).count() == 2


def test_word_hashes_depend_on_the_word_alone():
    rng = np.random.default_rng(1)
    words = [rng.integers(97, 99, k, np.uint8).tobytes() for k in [*range(1, 40), 255, 256, 257, 300] for _ in range(20)]
    hashes = {}
    for order in (words, words[::-1]):
        buf = np.frombuffer(b" ".join(order), np.uint8)
        for w, h in zip(order, word_hashes(buf, *spans_of(buf != 32)).tolist(), strict=True):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(set(words))


def test_runs_for_a_recall():
    assert near_duplicates.runs_for(0.9) < near_duplicates.runs_for(0.99) < near_duplicates.runs_for(0.9999) <= 12
    for recall in (0.9, 0.99, near_duplicates.RECALL):
        for depth in (1, 2, near_duplicates.DEPTH):
            assert 1 - (1 - near_duplicates.together(0.8, depth)) ** near_duplicates.runs_for(recall) >= recall


def test_measured_recall(spark, monkeypatch):
    """Pairs of similarity just above 0.8, all buckets split to the greatest depth: with one run, links are missed as the formula says; with those of the target, none."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        a = [f"v{x}" for x in rng.integers(0, 10**9, 200)]
        b = [*a[:100], f"y{k}", *a[101:160], f"z{k}", *a[161:190], f"x{k}", *a[191:]]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = sum(n for *_, n in near(docs.collect()).elements())
    assert pairs == 600
    monkeypatch.setattr(near_duplicates, "BUCKET", 1)
    found = lambda recall: sum(r.n_links for r in near_duplicates.classes(docs, recall).collect()) / pairs
    one = found(0.5)
    s = near_duplicates.together(0.8)
    assert near_duplicates.runs_for(0.5) == 1 and s - 0.1 <= one < 1
    assert found(near_duplicates.RECALL) == 1


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9)], "doc_id bigint, text string, `a-b c.d` int")
    assert sorted(r[2] for r in near_duplicates.distinct_documents(docs).collect()) == [7, 9]


def test_one_of_each_class(spark, messy):
    kept = near_duplicates.distinct_documents(messy)
    assert kept.columns == messy.columns
    rows = messy.collect()
    blank = sum(1 for r in rows if not shingles(r.text))
    classes = {NULL_ID if c is None else c for _, c, _ in near([r for r in rows if shingles(r.text)])}
    got = kept.collect()
    assert sum(1 for r in got if not shingles(r.text)) == blank
    assert sorted(key(r) for r in got if shingles(r.text)) == sorted(classes)


def by_row(rows, columns):
    return Counter((r.doc_id, *[bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns], tuple(map(tuple, r.spans))) for r in rows)


def runs_of(cov):
    at = [k for k in range(len(cov) + 1) if (k < len(cov) and cov[k]) != (k > 0 and cov[k - 1])]
    return tuple(zip(at[::2], at[1::2]))


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3000, "hot": 3}])
def test_what_is_kept(messy, sizes):
    """Texts and spans by brute force, for both operators."""
    docs = messy.collect()
    for op, w, split, join, within in ((suffix_tree_dedup, 20, lambda t: re.findall(WORD, t), " ".join, True), (suffix_array_dedup, 50, lambda t: [bytes([b]) for b in t.encode()], b"".join, False)):
        least = {}
        for r in docs:
            t = split(r.text or "")
            for k in range(len(t) - w + 1):
                least[tuple(t[k : k + w])] = min(least.get(tuple(t[k : k + w]), (NULL_ID + 1, 0)), (key(r), k))
        want = Counter()
        for r in docs:
            t = split(r.text or "")
            cov = [False] * len(t)
            for k in range(len(t) - w + 1):
                first = least[tuple(t[k : k + w])]
                if first < (key(r), k) if within else first[0] < key(r):
                    cov[k : k + w] = [True] * w
            want[(r.doc_id, len(t), join([x for x, c in zip(t, cov) if not c]), runs_of(cov))] += 1
        got = op.kept(messy, **sizes)
        assert by_row(got.collect(), [got.columns[1], "kept"]) == want
        assert any(spans for *_, spans in want)
