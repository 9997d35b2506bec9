"""Batches for training: seeded epoch order, batch and micro-batch numbers, shares of losses, resuming a shard."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seeded
from quarry.operators.packing import pad_waste
from quarry.operators.prefix import numbered
from quarry.operators.sampling import first_rows


def epoch_order(ids: DataFrame, id: str, seed: int, epoch: int) -> DataFrame:
    """ids with place: the epoch's order by digest.  Only ids are sorted, never tokens, and in ranges."""
    return numbered(ids.select(id, seeded(F.col(id), seed + epoch).alias("_digest")), ["_digest", id], "place").drop("_digest")


def batches(items: DataFrame, id: str, size: int, seed: int, epoch: int = 0, shuffle: bool = True, drop_last: bool = True) -> DataFrame:
    """items with batch_id and slot (its place in the batch)."""
    order = epoch_order(items, id, seed, epoch) if shuffle else numbered(items.select(id), [id], "place")
    if drop_last:
        order = order.where(F.col("place") < order.count() // size * size)
    return items.join(order, id).withColumn("batch_id", F.expr(f"place DIV {size}")).withColumn("slot", F.expr(f"place % {size}")).drop("place")


def iterate(batched: DataFrame) -> Iterator:
    """Rows in the order of batches, partition by partition; the driver never holds more than one."""
    return batched.orderBy("batch_id", "slot").toLocalIterator(prefetchPartitions=True)


def micro_batches(batched: DataFrame, size: int) -> DataFrame:
    """batched with micro_id and share: the part of the batch that the micro-batch is, by which its mean loss counts."""
    df = batched.withColumn("micro_id", F.expr(f"slot DIV {size}"))
    here = F.count("*").over(Window.partitionBy("batch_id", "micro_id"))
    return df.withColumn("share", here / F.count("*").over(Window.partitionBy("batch_id")))


def resume_shard(rows: DataFrame, shard: int, skip: int, seq: str = "seq") -> DataFrame:
    """A shard's rows after the first `skip`, as a retry goes on."""
    nth = F.row_number().over(Window.partitionBy("shard").orderBy(seq))
    return rows.where(F.col("shard") == shard).withColumn("_nth", nth).where(F.col("_nth") > skip).drop("_nth")


def resume_source(rows: DataFrame, skip: int, seq: str = "seq") -> DataFrame:
    """A source's rows after the first `skip` in sequence, whichever shards those lie in: the last number read is looked up, what lies beyond is a filter.  seq is a row's own."""
    if not skip:
        return rows
    last = first_rows(rows.select(seq).where(F.col(seq).isNotNull()), seq, skip).agg(F.max(seq)).first()[0]
    return rows if last is None else rows.where((F.col(seq) > last) | F.col(seq).isNull())


def buffered_shuffle(ids: DataFrame, id: str, size: int, seed: int, workers: int = 1) -> DataFrame:
    """ids with worker and place: each worker (every `workers`-th id) reads its ids in order through a buffer of `size`, gives a
    random one whenever it is full, and what is left in random order.  Only ids pass."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rng, held, out = random.Random(f"{seed}:{rows['worker'].iloc[0]}"), [], []
        for i in rows[id].sort_values():
            held.append(i)
            if len(held) >= size:
                k = rng.randrange(len(held))
                held[k], held[-1] = held[-1], held[k]
                out.append(held.pop())
        rng.shuffle(held)
        out += held
        return pd.DataFrame({id: out, "worker": rows["worker"].iloc[0], "place": range(len(out))})

    dealt = ids.select(id, F.pmod(F.col(id), F.lit(workers)).cast("bigint").alias("worker"))
    return dealt.groupBy("worker").applyInPandas(work, f"{id} bigint, worker bigint, place bigint")


def metrics(blocks: DataFrame, padded: DataFrame, block: int, batch_size: int, max_length: int, measured: int) -> DataFrame:
    """One row of what a loader gives: blocks with a next one, batches of an epoch, shapes, and the share of padding over the first `measured` padded batches."""
    n = blocks.agg((F.greatest(F.count("*") - 1, F.lit(0))).alias("packed_blocks"))
    waste = pad_waste(padded.where(F.col("batch_id") < measured), max_length).agg(F.avg("pad_fraction").alias("padded_mean_pad_fraction"), F.count("*").alias("padded_batches_measured"))
    shape = F.array(F.lit(batch_size), F.lit(block))
    return n.crossJoin(waste).select(F.lit(batch_size).alias("batch_size"), F.lit(block).alias("block_size"), "packed_blocks", F.expr(f"packed_blocks DIV {batch_size}").alias("batches_per_epoch"), shape.alias("packed_batch_shape"), F.lit(0.0).alias("packed_pad_fraction"), "padded_mean_pad_fraction", "padded_batches_measured")
