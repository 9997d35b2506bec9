"""Flat token files: separator scan and training order against the tokenizer itself."""

from collections import Counter

import numpy as np
import pytest

from quarry.llm import flat_tokens, token_counts, training_order
from quarry.llm.tokens import word_bpe


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block,span", [(1 << 16, 1024), (7, 3), (1, 2)])
def test_counts(messy, nothing, ids, block, span):
    docs = messy if block > 1 else messy.where("length(text) < 200")
    got = token_counts.count_documents(docs, word_bpe(), block, span).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(ids(r.text))) for r in docs.collect())
    assert sorted(r.nth for r in got) == list(range(len(got)))
    assert token_counts.count_documents(nothing, word_bpe(), block, span).count() == 0


def test_files_from_elsewhere(spark, tmp_path):
    s = flat_tokens.SEPARATOR
    np.array([1, 2, s, s, 3, 4, 5, 6, 7, s, 8], "<u2").tofile(tmp_path / "a.bin")
    np.array([1] * 20, "<u2").tofile(tmp_path / "b.bin")
    got = token_counts.count(flat_tokens.of_files(spark, str(tmp_path / "*.bin"), 3), 3, span=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.file, []).append((r.nth, r.n_tokens, r.complete))
    assert sorted(sorted(v) for v in by.values()) == [[(0, 2, True), (1, 0, True), (2, 5, True), (3, 1, False)], [(0, 20, False)]]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n, dtype=np.uint64)
    y = training_order.permute(x, n, 42)
    assert sorted(y.tolist()) == list(range(n))
    assert (training_order.permute(y, n, 42, inverse=True) == x).all()
    assert n < 5 or (y != x).any() and (training_order.permute(x, n, 43) != y).any()


def stream(rows):
    """The tokens of the sequences in the order of their numbers, without filling."""
    return [t for r in sorted(rows, key=lambda r: r.number) for t in np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist()]


def in_stable_order(docs, ids):
    """What the stream must be for documents that aren't read from files: by id; ties are copies or told apart by the test."""
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    return [[*ids(r.text), flat_tokens.SEPARATOR] for r in rows]


@pytest.mark.parametrize("size", [{"stride": 16, "shard": 8, "block": 50}, {"stride": 64, "shard": 3, "block": 16}, {"stride": 16, "shard": 8}])
def test_training_order(spark, messy, nothing, ids, tmp_path, size):
    stride, shard = size["stride"], size["shard"]
    rows = training_order.materialise_order(messy, word_bpe(), **size, folder=str(tmp_path / "s")).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.number for r in rows) == list(range(n))
    assert all(len(r.tokens) == 2 * stride and r.shard == r.slot // shard and r.byte_offset == r.slot % shard * 2 * stride for r in rows)
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.number)][:-1] == [stride] * (n - 1)
    docs = in_stable_order(messy, ids)
    flat, own = [t for d in docs for t in d], stream(rows)
    assert own[: sum(map(len, docs[:-2]))] == flat[: sum(map(len, docs[:-2]))] and sorted(own) == sorted(flat)
    assert Counter(i for r in rows for i in r.doc_ids) == Counter(r.doc_id for r in messy.collect())
    assert training_order.materialise_order(nothing, word_bpe(), **size).count() == 0
    by = {r.slot: bytes(r.tokens) for r in rows}
    for slot in (0, 9, n - 1):
        assert [x.tobytes() for x in training_order.read_from(str(tmp_path / "s"), slot, stride, shard)] == [by[k] for k in range(slot, n)]


def test_order_is_stable(spark, messy, tmp_path):
    """The same slots for any partitioning, of files and of frames."""
    messy.repartition(5).write.parquet(f"{tmp_path}/d")
    seen = []
    try:
        for n_bytes in ("3k", "100m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", n_bytes)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            docs = spark.read.parquet(f"{tmp_path}/d")
            rows = training_order.materialise_order(docs, word_bpe(), stride=16, shard=8).collect()
            counts = token_counts.count_documents(docs, word_bpe(), 64, 2).collect()
            seen.append((docs.rdd.getNumPartitions(), sorted((r.slot, r.number, bytes(r.tokens)) for r in rows), sorted((r.nth, r.n_tokens) for r in counts)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0][0] != seen[1][0] and seen[0][1:] == seen[1][1:]
    frames = [training_order.materialise_order(messy.repartition(k), word_bpe(), stride=16, shard=8).collect() for k in (3, 8)]
    assert sorted((r.slot, bytes(r.tokens)) for r in frames[0]) == sorted((r.slot, bytes(r.tokens)) for r in frames[1])


def test_long_text(spark, ids, tmp_path):
    """A document of 300,000 words among short ones."""
    long = " ".join(f"w{k % 977}" for k in range(300_000))
    docs = spark.createDataFrame([(1, "a b"), (2, long), (3, None)], "doc_id bigint, text string")
    rows = training_order.materialise_order(docs, word_bpe()).collect()
    assert stream(rows) == [t for x in ("a b", long, "") for t in [*ids(x), flat_tokens.SEPARATOR]]
    assert {r.doc_id: r.n_tokens for r in token_counts.count_documents(docs, word_bpe()).collect()} == {1: len(ids("a b")), 2: len(ids(long)), 3: 0}


def test_other_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_000)} | {"<|endoftext|>": 70_000}, unk_token="w0")).save(f"{tmp_path}/large.json")
    Tokenizer(models.WordLevel({"w0": 0}, unk_token="w0")).save(f"{tmp_path}/bare.json")
    for name in ("large", "bare"):
        with pytest.raises(ValueError):
            flat_tokens.separator_of(f"{tmp_path}/{name}.json")


def test_query_writes_the_shards(spark, messy, tmp_path, monkeypatch):
    from quarry.llm import queries

    monkeypatch.setattr(queries, "shared_folder", lambda spark: f"file:{tmp_path}/shared")
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.op3_training_order(spark, str(tmp_path)).collect(), key=lambda r: r.slot)
    (folder,) = (tmp_path / "shared").iterdir()
    assert [x.tobytes() for x in training_order.read_from(str(folder), 0)] == [bytes(r.tokens) for r in rows]
    assert len(rows) == len({r.slot for r in rows}) > 1 and not list(folder.glob("*.part"))
