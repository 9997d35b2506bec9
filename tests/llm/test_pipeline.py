"""The pipeline's stages one by one, and its result against what the stages left."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
from test_dedup import key, near, shingles
from test_scans import contaminated, measured
from test_secrets_packing import SECRETS, found
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import decontaminate, quality_rules
from quarry.llm.tokens import word_bpe


def test_stages(spark, messy, tmp_path):
    leaked = " ".join(f"t{i}" for i in range(50))
    secret = spark.createDataFrame([(400, "pass " + " ".join(f"q{i}" for i in range(40)) + " password=abcdefghijklmn", "en", "s", 1, "", "", "", ""), (401, leaked, "en", "s", 1, "", "", "", "")], messy.schema)
    docs = messy.union(secret)
    item = " ".join(leaked.split()[3:20])
    messy_dir = str(tmp_path)
    docs.write.parquet(f"{messy_dir}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{messy_dir}/benchmark.parquet")
    now = spark.read.parquet(f"{messy_dir}/documents.parquet")
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, messy_dir)
        assert now.columns == docs.columns, name
        now = now.cache()
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    left = now.collect()
    assert all("abcdefghijklmn" not in r.text for r in left) and any("[SECRET]" in r.text for r in left)
    assert quality_rules.verdict(quality_rules.ledger(now), "standard/1").where("NOT kept").count() <= 1
    assert decontaminate.scan(now, spark.read.parquet(f"{messy_dir}/benchmark.parquet")).where("contaminated").count() == 0
    packed = corpus_pipeline.run(spark, messy_dir).collect()
    assert {key(r) for r in packed} == {key(r) for r in left}


def by_brute_force(rows, items):
    """(doc_id, text) of what the first four stages leave of rows, by plain Python."""
    kept = []
    for r in rows:
        n, chars, symbols, _, _, failed = measured(r.text)
        if not (failed or symbols > 0.3 * chars or chars > 40 * n or chars < 1.5 * n):
            kept.append(r)
    best, class_of = {}, {}
    for doc, group, _ in near(kept):
        class_of[doc] = group
    alone = []
    for r in kept:
        if not shingles(r.text):
            alone.append(r)
            continue
        at = (key(r), hashlib.md5(r.text.encode()).hexdigest())
        group = class_of[r.doc_id]
        if group not in best or at < best[group][0]:
            best[group] = (at, r)
    out = []
    for r in [*alone, *(r for _, r in best.values())]:
        if contaminated(r.text, items)[-1]:
            continue
        spans, at, parts = [x.split(":") for x in found(r.text)[-1].split(",") if x], 0, []
        for _, s, e in spans:
            if int(s) > at or not parts:
                parts.append(r.text[at : max(at, int(s))])
            at = max(at, int(e))
        out.append((r.doc_id, "[SECRET]".join([*parts, r.text[at:]]) if spans else r.text))
    return out


def test_result_by_brute_force(spark, messy, tmp_path):
    """The pipeline's rows: ids of documents, pieces, tokens, and places without gaps."""
    t = Tokenizer.from_file(word_bpe())
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("abcdefghijklm") * rng.randint(2, 5) + rng.choice("xyz") for _ in range(n))
    base, leaked = prose(300), prose(60)
    more = [prose(rng.randint(20, 90)) for _ in range(30)]
    more += [base, base.replace(base.split()[7], "other", 1), base + " tail", "pre " + base, leaked + " " + prose(30), prose(15) + " " + " ".join(leaked.split()[20:40])]
    more += [prose(40) + " " + s + " " + prose(12) for s in SECRETS if len(s) < 3000] + [prose(6000), more[3], "* # $ " * 30 + prose(11), "漢字 " * 40]
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = docs.union(spark.createDataFrame([(1000 + k, x, "en", "s", len(x)) for k, x in enumerate(more)], docs.schema))
    docs = docs.union(docs.where("doc_id IN (1003, 1030)"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(leaked.split()[5:50])), (2, None), (3, "nothing of this is anywhere")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = by_brute_force(spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), items)
    want = Counter()
    for doc, text in left:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.update((doc, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    # something went at each stage
    assert len(left) < docs.count() - 6 and any("[SECRET]" in x for _, x in left) and not {1031, 1032, 1033, 1034, 1035} & {d for d, _ in left}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(b))]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 4096


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
