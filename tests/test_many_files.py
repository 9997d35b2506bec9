"""Queries on tables of many files, whose rows aren't in the order of the files, against the same SQL."""

import os
from collections import Counter

import duckdb
import pytest

from quarry import queries
from quarry.operators import packing
from quarry.sources import token_files

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("many"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")).repartition(5, "doc_id").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["collection_manifest", "pinned_rest", "pinned_documents"])
def test_against_sql(spark, many, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{many}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, many)
    columns = sorted(got.columns)
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(rows)


def test_whole_words_count():
    """Ids are of whole words: those alike in letters and length at both ends differ, and no id is the end of a document."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT 0 AS doc_id, 'src0' AS source, 'bread breed' AS text, 'en' AS lang")
    ids = con.execute(f"WITH {queries.DIGESTS} SELECT tokens FROM tok").fetchone()[0]
    assert len(set(ids)) == 3 and ids[-1] == packing.DIGEST_EOS and max(ids[:-1]) < packing.DIGEST_EOS


@pytest.mark.parametrize("name", ["pack_blocks", "next_token_pairs", "page_windows", "page_sample", "pad_batches", "truncate_documents", "token_file_round_trip", "token_manifest"])
def test_queries_take_whole_words(name):
    assert queries.DIGESTS in queries.ORACLES[name] and queries.TOKENS not in queries.ORACLES[name]


def test_files_of_32_bits(spark, tmp_path):
    blocks = spark.createDataFrame([("train", i, [65_536, i, 70_000]) for i in range(5)], "split string, block_id bigint, tokens array<int>")
    done = token_files.write_blocks(blocks, str(tmp_path / "t"), 3, per_file=4, bits=32)
    assert sorted(r.n_bytes for r in done.collect()) == [12, 48]
    assert sorted(token_files.read_blocks(spark, str(tmp_path / "t"), 3, per_file=4, bits=32).collect()) == sorted(blocks.collect())
