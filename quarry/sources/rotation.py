"""Where a writer that rotates begins its files: a new file once the last one has reached its limit, by one record at most beyond.

A file begins at the first record before which the file has its limit, so where files begin is a chain: each beginning gives the
next by a search in running sums.  The chain is followed in ranges of bytes: within a range all beginnings that
are possible are followed at once by pointer jumping, which gives a map from where the chain comes in to where it goes out; maps of
neighbouring ranges are composed up a tree, and down it each range learns where the chain comes in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.prefix import running_sum
from quarry.sources.storage import discard, materialise

#: Files of a range; maps that are composed at a time.
FILES, FAN = 64, 16

_MAP = "id bigint, entries array<bigint>, exits array<bigint>"


def jumped(before: np.ndarray, limit: int) -> np.ndarray:
    """For a file that begins at each record of a range (bytes before it, ascending), the bytes at which the first file beyond the range may begin."""
    n = len(before)
    step, out = np.searchsorted(before, before + limit), before + limit
    while (inside := np.flatnonzero(step < n)).size:
        to = step[inside]
        out[inside], step[inside] = out[to], step[to]
    return out


def followed(maps: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> list[np.ndarray]:
    """What `at` (bytes from which on a file begins) has become before each of the maps, and after the last."""
    out = [at]
    for entries, exits in maps:
        k = np.searchsorted(entries, at)
        at = np.where(k < len(entries), exits[np.minimum(k, len(entries) - 1)], at)
        out.append(at)
    return out


def _lists(ids: list[int], entries: list[np.ndarray], exits: list[np.ndarray]) -> pa.Table:
    kind = pa.list_(pa.int64())
    return pa.table({"id": pa.array(ids, pa.int64()), "entries": pa.array(entries, kind), "exits": pa.array(exits, kind)})


def _maps(t: pa.Table) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    t = t.sort_by("id")
    return t["id"].to_pylist(), [(np.array(e), np.array(x)) for e, x in zip(t["entries"].to_pylist(), t["exits"].to_pylist(), strict=True)]


def first_records(sizes: DataFrame, limit: int, files: int = FILES, fan: int = FAN) -> list[int]:
    """The seq of each file's first record, ascending, from (seq, size): sizes above 0, seq a record's own.  They come to the driver, a number for each file."""
    width = files * limit
    table = materialise(sizes.select(F.col("seq").cast("bigint").alias("seq"), F.col("size").cast("bigint").alias("size")))
    rows = materialise(running_sum(table, "size", "seq", "before").select("seq", "before", F.expr(f"before DIV {width}").alias("id")))

    def leaf(key: tuple, t: pa.Table) -> pa.Table:
        before, begins = np.sort(t["before"].to_numpy()), key[0].as_py() * width
        # whatever comes in from the left begins at the first record after begins + limit at last
        some = int(np.searchsorted(before, begins + limit)) + 1
        return _lists([key[0].as_py()], [before[:some]], [jumped(before, limit)[:some]])

    def compose(key: tuple, t: pa.Table) -> pa.Table:
        _, maps = _maps(t)
        entries = maps[0][0]
        # one more, for what comes in after the first range's last record
        entries = np.append(entries, entries[-1] + limit)
        return _lists([key[0].as_py()], [entries], [followed(maps, entries)[-1]])

    def descend(key: tuple, t: pa.Table) -> pa.Table:
        ids, maps = _maps(t)
        came = followed(maps, np.array([t["came"][0].as_py()]))
        return pa.table({"id": pa.array(ids, pa.int64()), "came": pa.array([int(c[0]) for c in came[:-1]], pa.int64())})

    def walk(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("before")
        before, seq, at, found = t["before"].to_numpy(), t["seq"].to_numpy(), t["came"][0].as_py(), []
        while (k := int(np.searchsorted(before, at))) < len(before):
            found.append(int(seq[k]))
            at = int(before[k]) + limit
        return pa.table({"seq": pa.array(found, pa.int64())})

    levels = [materialise(rows.groupBy("id").applyInArrow(leaf, _MAP))]
    while levels[-1].count() > 1:
        up = levels[-1].withColumn("up", F.expr(f"id DIV {fan}")).groupBy("up").applyInArrow(compose, _MAP)
        levels.append(materialise(up))
    came = levels[-1].select("id", F.lit(0).cast("bigint").alias("came"))
    for level in levels[-2::-1]:
        below = level.withColumn("up", F.expr(f"id DIV {fan}")).join(came.withColumnRenamed("id", "up"), "up")
        came = materialise(below.groupBy("up").applyInArrow(descend, "id bigint, came bigint"))
    found = rows.join(came, "id").groupBy("id").applyInArrow(walk, "seq bigint")
    out = sorted(r["seq"] for r in found.collect())
    discard(table, rows, *levels)
    return out
