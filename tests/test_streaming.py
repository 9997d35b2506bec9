"""Bounded streaming dedup: restart, time to live, filters, nulls, hot texts, clashing names."""

import time

import numpy as np
import pytest

from quarry.streaming import dedup

SCHEMA = "doc_id bigint, text string, source string"
DAY = 86_400_000


@pytest.fixture
def rocksdb(spark):
    for name, value in dedup.SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name in dedup.SETTINGS:
        spark.conf.unset(name)


class Arrivals:
    """Files that arrive in a folder, and what has been written of them so far."""

    def __init__(self, spark, folder, **bounds):
        self.spark, self.bounds = spark, bounds
        self.path, self.out, self.checkpoint = (str(folder / x) for x in ("in", "out", "checkpoint"))

    def __call__(self, *rows):
        before = {r.doc_id for r in self.read()}
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        stream = dedup.dedup_bounded(dedup.arriving(self.spark, self.path, SCHEMA), **self.bounds)
        self.query = dedup.run_once(stream, self.out, self.checkpoint)
        return sorted((r.doc_id, r.text, r.seen) for r in self.read() if r.doc_id not in before)

    def read(self):
        try:
            return self.spark.read.parquet(self.out).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []


def test_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 4000, np.uint64)
    f = dedup.Filter(4000, None)
    f.add(keys)
    again = dedup.Filter(4000, f.bytes.tobytes())
    assert again.holds(keys).all() and not dedup.Filter(4000, None).holds(keys).any()
    assert again.holds(rng.integers(0, 2**64, 200_000, np.uint64)).mean() < 1e-3


def test_resumes_with_nulls_and_hot_texts(rocksdb, tmp_path):
    come = Arrivals(rocksdb, tmp_path, shards=2, capacity=1000)
    got = come(*[(k, "hot", "s") for k in range(500)], (600, None, "s"), (601, None, None), (602, "", "s"))
    assert [t for _, t, _ in got if t is not None].count("hot") == 1
    assert [(t, v) for _, t, v in got if t != "hot"] == [(None, "new"), (None, "new"), ("", "new")]
    # another query over the same checkpoint knows what came before
    assert come((700, "hot", "t"), (701, "", "t"), (702, None, "t"), (703, "b", "t")) == [(702, None, "new"), (703, "b", "new")]
    assert come((800, "b", "u"), (801, "x" * 2_000_000, "u"), (802, "x" * 2_000_000 + "y", "u")) == [(801, "x" * 2_000_000, "new"), (802, "x" * 2_000_000 + "y", "new")]


def test_time_to_live_and_forgetting(rocksdb, tmp_path):
    come = Arrivals(rocksdb, tmp_path, shards=1, capacity=2, ttl_ms=1)
    assert come((1, "a", "s")) == [(1, "a", "new")]
    time.sleep(0.1)
    # let go by the time to live, known to the filter: given, and marked
    assert come((2, "a", "s"), (3, "b", "s")) == [(2, "a", "maybe"), (3, "b", "new")]
    time.sleep(0.1)
    # a and b fill one filter, c and d the next: then a and b are forgotten
    come((4, "c", "s"), (5, "d", "s"))
    time.sleep(0.1)
    come((6, "e", "s"), (7, "f", "s"))
    time.sleep(0.1)
    assert come((8, "a", "s"))[0] == (8, "a", "new")


def test_forgotten_by_filters_alone(rocksdb, tmp_path):
    """What is within its time to live comes once, however small the filters are."""
    come = Arrivals(rocksdb, tmp_path, shards=1, capacity=2)
    assert len(come(*[(k, f"text {k}", "s") for k in range(9)])) == 9
    assert come(*[(10 + k, f"text {k}", "s") for k in range(10)]) == [(19, "text 9", "new")]


def test_state_is_bounded(rocksdb, tmp_path):
    """Beyond the time to live, state doesn't grow with the texts seen."""
    come = Arrivals(rocksdb, tmp_path, shards=1, capacity=1000, ttl_ms=1)
    sizes = []
    for k in range(3):
        assert len(come(*[(3000 * k + j, f"text {k} {j}", "s") for j in range(3000)])) == 3000
        sizes.append(come.query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(0.1)
    assert sizes[2] <= sizes[1] <= sizes[0] + 2


def test_refusals(rocksdb, tmp_path):
    rocksdb.createDataFrame([(1, "a", "s")], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = dedup.arriving(rocksdb, str(tmp_path / "in"), SCHEMA)
    with pytest.raises(ValueError, match="seen"):
        dedup.dedup_bounded(stream.withColumnRenamed("source", "seen"))
    rocksdb.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    with pytest.raises(ValueError, match="noData"):
        dedup.dedup_bounded(stream)
