"""The driver's entry points, and queries against DuckDB's answers on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry import queries
from quarry.sources import records

DATA = "/root/testdata/sf0.001"
SOME = ["clean_funnel", "clean_funnel_pages", "clean_documents", "clean_manifest_grouping_sets", "normalize_documents", "normalize_pages", "word_stats", "quality_verdicts", "dedup_raw", "shard_permutation", "hash_split", "doc_length_distribution", "pack_blocks", "next_token_pairs", "page_windows", "epoch_shuffle", "pad_batches", "log_windows", "run_summary", "ema_loss", "eval_points", "factor_spread", "format_labels", "topk_logits", "softmax_sample", "collection_manifest", "cleaning_manifest", "token_manifest", "jsonl_round_trip", "token_file_round_trip", "loader_metrics", "log_throughput", "epoch_history", "run_epochs", "sweep_findings", "stream_dedup_bounded"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert {r.verdict: r.docs for r in __spark_entry__.entry(spark).collect()} == {"dup_raw": 11, "dup_normalized": 0, "empty": 0, "short": 12, "word_length": 0, "symbol_ratio": 10, "repetitive": 0}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    assert Counter(tuple(map(plain, r)) for r in got.select(columns).collect()) == Counter(tuple(map(plain, r)) for r in rows)


def test_nothing_spans_the_corpus(spark):
    """No plan over documents gathers them in one partition."""
    for name in ("clean_documents", "clean_funnel", "pack_blocks", "page_windows", "pad_batches", "dedup_normalized", "word_stats", "loader_batches", "epoch_shuffle", "stratified_sample"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan, name


def test_once(spark, monkeypatch):
    """Tokens of blocks and windows are made once: each plan reads the documents in one scan, and then the table written."""
    from quarry.operators import packing
    from quarry.sources import storage

    plans = []
    monkeypatch.setattr(packing, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.materialise(df))
    for name in ("page_windows", "pack_blocks"):
        plans.clear()
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        # the tokens and the sums of their partitions, which are ranges as they come
        assert len(plans) == 2 and plans[0].count("FileScan") == 1 and "FileScan parquet [doc_id" in plans[0], name
        assert not any("FileScan parquet [doc_id" in p for p in (plans[1], plan)), name


def test_dealt(spark):
    """Work on a table of one file is done after it is dealt out, and many files are left as they are."""
    docs = records.texts(spark, DATA, "documents")
    plan = docs.select(F.sha2("text", 256).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.index("sha2(") < plan.index("Repartition")
    assert docs.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_many_files_stay(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/t.parquet")
    assert "Repartition" not in records.texts(spark, str(tmp_path), "t")._jdf.queryExecution().optimizedPlan().toString()
