"""What the steps of the substring operators send and store."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import repeats, suffix_array_dedup, suffix_tree_dedup
from quarry.sources.storage import materialise

PLANS = [repeats.Plan(50, 16, False, False, suffix_array_dedup.refine), repeats.Plan(20, 6, True, True, suffix_tree_dedup.grow)]


def _texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh     ") for _ in range(3000)).encode() for _ in range(n)]


def _blob(texts):
    return repeats._zip(np.arange(len(texts)), np.array([len(t) for t in texts], np.int64), b"".join(texts))


def _grams_back(plan, texts, n_buckets, hot=50_000):
    """What comes back to two chunks of the same texts: rows of chunk 0, and how many grams it sent."""
    chunk = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array([_blob(texts)] * 2, pa.binary())], names=["chunk", "docs"])
    sent = pa.Table.from_batches(list(repeats._send_grams(plan, n_buckets)(iter([chunk])))).to_pylist()
    back = []
    for b in sorted({r["bucket"] for r in sent}):
        some = pa.Table.from_pylist([r for r in sent if r["bucket"] == b])
        back += repeats._repeated_grams(hot)((pa.scalar(b), pa.scalar(b)), some).to_pylist()
    return [r for r in back if r["chunk"] == 0], sum(len(repeats._unzip(r["sent"], "<u8", "<u4")[0]) for r in sent if r["chunk"] == 0)


def test_texts_arent_shuffled(spark, messy):
    for op in (suffix_array_dedup, suffix_tree_dedup):
        plan = op.kept(messy, chunk=4000)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange" in line and "REPARTITION_BY" not in line]
        assert len(moved) == 1, plan  # what comes back to the texts, alone
        assert "Bucketed: true" in plan


def test_bucketed_table(spark):
    """Its rows are grouped where they lie, and no name of it stays."""
    before = {t.name for t in spark.catalog.listTables()}
    df = materialise(spark.range(100).selectExpr("id % 7 AS k", "id AS v"), "k")
    sums = df.groupBy("k").sum("v")
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert dict(sums.collect()) == {k: sum(range(k, 100, 7)) for k in range(7)}
    assert {t.name for t in spark.catalog.listTables()} == before
    assert materialise(spark.range(0).selectExpr("id AS k"), "k").count() == 0


@pytest.mark.parametrize("plan", PLANS)
def test_grams_come_back_as_bits(plan):
    texts = _texts(20)
    back, n = _grams_back(plan, texts, 4)
    assert n > 1500 and len(back) == 4
    assert sum(len(r["back"]) for r in back) < n


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("hot", [0, 50_000])
def test_cells_are_known_by_their_text(plan, hot):
    """Gram and hash of a cell aren't sent: they follow from its text and from where in it the gram is."""
    texts = _texts(20)
    back, _ = _grams_back(plan, texts, 4, hot)
    n = 0
    for _, _, u, s, e, p, g, h, x in repeats._cells(plan, texts, [r["back"] for r in back], 4):
        assert h.all() if hot == 0 else not h.any()
        n += len(s)
        sizes = e + plan.window - s
        ends = np.cumsum(sizes)
        some = np.concatenate([u.values[a : b + plan.window] for a, b in zip(s, e, strict=True)])
        got_g, got_x = repeats.keys_of(plan, some, ends - sizes, ends, p - s)
        assert (got_g == g).all() and (got_x == x).all()
    assert n
    chunk = pa.table({"chunk": pa.array([0], pa.int64()), "docs": pa.array([_blob(texts)], pa.binary())})
    sent = repeats._send_cells(plan, 4)(None, chunk, pa.Table.from_pylist(back)).to_pylist()
    cells = [repeats._unzip(r["sent"], "<u4", "<i8", "<i8", "<u4", "u1", "<u4", None) for r in sent]
    assert sum(len(c[0]) for c in cells) == n
    assert sum(len(r["sent"]) - len(repeats._zip(c[6])) for r, c in zip(sent, cells, strict=True)) < 10 * n
