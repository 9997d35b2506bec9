"""Normalisation, quality verdicts and the cleaning plan."""

import json
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import quality
from quarry.functions.hashing import split_for
from quarry.functions.normalize import normalize
from quarry.plans import clean
from quarry.sources import records

CASES = {
    "Plain  TEXT\twith\r\nspaces ": "plain text with\nspaces",
    "<script>var a = '<b>';</script>x<STYLE type=a>p{}</style>y<!-- no\nno -->z<br/>": "x y z",
    "a <script>never closed": "a never closed",
    "[text](http://x.y/z) ![img](a.png) see [12] and [citation needed] [ nb 3 ] [edit]": "text img see and",
    "go to https://a.b/c?d=e now or www.x.org.": "go to now or",
    "# Head\n\n## Two\nbody # not": "head\ntwo\nbody # not",
    "a\n---\nb": "a\n---\nb",
    "a *b*\n---\nc": "a b\n\nc",
    "***\r\nx": "x",
    "**bold** __under__ `code` *it* _a_": "bold under code it a",
    "*" + "x" * 403 + "*": "*" + "x" * 403 + "*",
    "<" + "a" * 2001 + ">": "<" + "a" * 2001 + ">",
    "ﬁne ＡＢＣ x": "fine abc x",
    "zero​width﻿ bom": "zero width bom",
    "a\n \n \nb": "a\n\n\nb",
    "a\n\n\n\n\nb": "a\n\nb",
    "x\x1cy\x0bz\u0085w v": "x y z\u0085w v",
    "": "",
    "<p></p>": "",
}


def test_normalize_cases(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)] + [(99, None)], "k int, text string")
    got = {r.k: r.out for r in normalize(df, "text", "out").collect()}
    assert {t: got[k] for k, t in enumerate(CASES)} == CASES
    assert got[99] is None


def test_nfkc_only_touches_what_it_must(spark):
    texts = ["ascii", "é", "é", "①②", "㎏", None]
    df = normalize(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "out")
    assert [r.out for r in df.collect()] == [None if t is None else unicodedata.normalize("NFKC", t).lower() for t in texts]


def words(n, w="word"):
    return " ".join(f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


VERDICTS = [
    (words(49), "short"), (words(50), None), ("", "short"),
    (" ".join(["ab", "cd", "ef", "gh"] * 13), None), (" ".join(["a", "bc", "d", "ef"] * 13), "word_length"),
    (" ".join(f"{'x' * 14}{chr(97 + k % 26)}" for k in range(52)), None), (" ".join(f"{'x' * 15}{chr(97 + k % 26)}" for k in range(52)), "word_length"),
    (" ".join(["aaaa", "bbbb", "cccc", "dddd"] * 15) + " " + "#" * 100, None), (" ".join(["aaaa", "bbbb", "cccc", "dddd"] * 15) + " " + "#" * 101, "symbol_ratio"),
    (words(70) + " the" * 30, None), (words(69) + " the" * 31, "repetitive"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(VERDICTS)], "k int, t string")
    got = {r.k: r.v for r in quality.with_word_stats(df, "t").withColumn("v", quality.verdict()).collect()}
    assert [got[k] for k in range(len(VERDICTS))] == [v for _, v in VERDICTS]


def test_repetitive_is_the_counts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") * 2 for _ in range(rng.randint(1, 60))) for _ in range(200)]
    df = quality.with_word_stats(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t")
    for r in df.collect():
        w = texts[r.k].split()
        assert r.too_repetitive == (max(Counter(w).values()) > 3 * len(w) // 10), texts[r.k]


def raw(spark, texts):
    rows = [(k, k, "s" if k % 2 else "r", "d", 0, None, None, t) for k, t in enumerate(texts)]
    return records.raw_records(spark.createDataFrame(rows, "seq bigint, n bigint, source string, domain string, shard int, url string, title string, text string"))


GATES = [
    (words(60), None), (words(60), "dup_raw"), (words(60).upper(), "dup_normalized"), ("<p></p>", "empty"), ("<b></b>", "empty"), ("<p></p>", "dup_raw"),
    ("too short", "short"), ("Too  short", "dup_normalized"), ("too short", "dup_raw"), (words(60, "other"), None),
]


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_gates_and_funnel(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        judged = clean.judged(raw(spark, [t for t, _ in GATES]).repartition(int(partitions)), text=True)
        assert [r.verdict for r in judged.orderBy("seq").collect()] == [v for _, v in GATES]
        funnel = {r.verdict: (r.docs, r.bytes) for r in clean.funnel(judged).collect()}
        assert list(funnel) and set(funnel) == set(quality.VERDICTS)
        assert sum(d for d, _ in funnel.values()) + clean.kept(judged).count() == len(GATES)
        assert funnel["dup_raw"] == (3, len(words(60)) + 7 + 9)
        total = {(r.what, r.name): r.docs_in for r in clean.totals(judged).collect()}
        assert total["total", "all"] == len(GATES) == sum(n for (w, _), n in total.items() if w == "source")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_key_is_split(spark):
    from quarry.operators.dedup import mark_first

    df = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("key"))
    got = mark_first(df, "key", "seq", "first")
    assert got.where("first AND key = 'hot'").select("seq").collect() == [(0,)]
    assert got.where("key IS NULL AND first IS NULL").count() == df.where("key IS NULL").count()
    assert got.where("first").count() == 1 + df.where("key <> 'hot'").count()


def test_bitmaps(spark):
    """Numbers at the edges of buckets, far apart, and ranges of bitmaps that hold one bucket each."""
    from quarry.operators import dedup

    numbers = [0, 1, 2, 7, 8, 32767, 32768, 32769, 65536, 65537, 10**12, 10**12 + 8, 5 * 10**12]
    df = spark.createDataFrame([(n, f"k{n}") for n in numbers] + [(n + 3, f"k{n}") for n in numbers[:1] + numbers[8:]] + [(10**13, None)], "seq bigint, key string").repartition(5)
    found = dedup.survivors(df, "key", "seq")
    for most in (dedup.MOST, 4096, 8192):
        got = dedup.mark(df, found, "seq", "first", most).collect()
        assert sorted(r.seq for r in got if r.first) == numbers and len(got) == df.count()
    assert dedup.mark(df.limit(0), found, "seq", "first").count() == 0
    assert dedup.mark(df, found.limit(0), "seq", "first").where("first").count() == 0


def test_texts_are_scanned_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    from quarry.operators import dedup
    from quarry.sources import storage

    spark.createDataFrame([(k, words(60, f"v{k % 40}"), "en", "s") for k in range(80)], "doc_id bigint, text string, lang string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    for m in (clean, dedup):
        monkeypatch.setattr(m, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.materialise(df))
    for text in (False, True):
        plans.clear()
        last = clean.judged(records.documents(spark, str(tmp_path)), text=text)
        last = clean.kept(last) if text else clean.funnel(last)
        plans.append(last._jdf.queryExecution().executedPlan().toString())
        assert sum(p.count("FileScan parquet [doc_id") for p in plans) == 1 and "Exchange" not in plans[0]
        shuffled = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
        assert shuffled and not any("text" in line for line in shuffled)
        assert not any("Join" in line and "BroadcastHashJoin" not in line and "verdict" not in line for line in plans[-1].splitlines())
    assert last.count() == 40


def test_split_is_a_partition_by_id_alone(spark):
    df = spark.range(2000).select(F.concat(F.lit("wikipedia:"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("id"))
    val = df.where(split_for(F.col("id"), 100) == "val").count()
    assert 120 < val < 280
    assert df.where("id = 'wikipedia:00000000'").select(split_for(F.col("id"), 760), split_for(F.col("id"), 761)).first() == ("train", "val")


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [(k, f"s:{k:08d}", "s", "d", 0, None, "t" * (k % 7), "h", k, {3: 'b\n"c"', 5: "é漢", 8: None}.get(k, "x" * (37 * k % 200))) for k in range(60)]
    df = spark.createDataFrame(rows, f"seq bigint, {records.RAW}").repartition(5)
    records.write_jsonl(df, path, "seq", 1500)
    back = records.read_jsonl(spark, path, f"seq bigint, {records.RAW}")
    files = {}
    for r in back.collect():
        files.setdefault(r.file, []).append(r)
    assert [r.seq for f in sorted(files) for r in sorted(files[f], key=lambda r: r.place)] == list(range(60)) and len(files) > 3
    size = lambda r: len(json.dumps({c: r[c] for c in df.columns}, separators=(",", ":"), ensure_ascii=False).encode()) + 1
    assert all(sum(map(size, f)) < 1500 + 400 for f in files.values())
    assert sorted(back.select(df.columns).collect(), key=lambda r: r.seq) == sorted(df.collect(), key=lambda r: r.seq)
    assert [r.seq for r in records.read_jsonl(spark, path, f"seq bigint, {records.RAW}", limit=7).collect()] == list(range(7))
    assert records.digests(spark, f"{path}/file=*/*.gz").count() == len(files)
    assert all(re.fullmatch(r".*\.json\.gz", r.path) and len(r.sha256) == 64 for r in records.digests(spark, f"{path}/file=*/*.gz").collect())
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        records.write_jsonl(df, path, "seq")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_jsonl(spark, str(tmp_path / "none")).count()
    records.write_jsonl(df.limit(3), path, "seq", overwrite=True)
    assert records.read_jsonl(spark, path).count() == 3



def test_record_ids_of_any_length(spark):
    from quarry.functions.hashing import record_id

    ns = [0, 7, 99_999_999, *range(100_000_000, 100_000_010), 12_345_678_901]
    got = spark.createDataFrame([("a", n) for n in ns], "source string, n bigint").select("n", record_id(F.col("source"), F.col("n")).alias("id")).collect()
    assert {r.n: r.id for r in got} == {n: f"a:{n:08d}" for n in ns}
