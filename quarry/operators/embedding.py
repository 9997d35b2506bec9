"""Embedding lookup: token ids to vectors, and a document's mean vector, by blocked gather."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a block of the table: what a group has in memory of it, times the vectors' width.
BLOCK = 1024
#: Documents that meet a copy of a block.
SHARE = 1 << 18
#: Rows that are worked on at a time.
ROWS = 1024


def _needs(block: int):
    """seq, block, ids, times: of each document (seq, tokens) its different ids, with how often, by block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            seqs, blocks, ids, times = [], [], [], []
            for seq, tokens in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                some, n = np.unique(tokens.values.to_numpy(zero_copy_only=False) if tokens.is_valid else np.zeros(0, np.int64), return_counts=True)
                cuts = np.flatnonzero(np.diff(some // block)) + 1
                for i, t in zip(np.split(some, cuts), np.split(n, cuts), strict=True):
                    if len(i):
                        seqs.append(seq)
                        blocks.append(int(i[0]) // block)
                        ids.append(i)
                        times.append(t)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(blocks, pa.int64()), pa.array(ids, kind), pa.array(times, kind)], names=["seq", "block", "ids", "times"])

    return work


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq, n, total: of each document the sum of a block's vectors, each as often as the document has its id.

    Rows (block, share, asks, id, vector, ids, times) come sorted: a block's vectors, then the documents of a share that ask for them.
    Of a task, a block and some rows are in memory, however many documents ask.
    """
    key, own, matrix = None, np.zeros(0, np.int64), np.zeros((0, 0))
    for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        block, share, asks = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(share) != 0) | (np.diff(asks) != 0)) + 1
        seqs, ns, totals = [], [], []
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            rows = b.slice(a, z - a)
            if key != (block[a], share[a]):
                key, own, matrix = (block[a], share[a]), np.zeros(0, np.int64), np.zeros((0, 0))
            if not asks[a]:
                more = rows.column(4).flatten().to_numpy().reshape(z - a, -1)
                own = np.concatenate((own, rows.column(3).to_numpy()))
                matrix = np.concatenate((matrix, more)) if len(matrix) else more
                continue
            if not len(own):
                continue
            ids, times = rows.column(5).flatten().to_numpy(), rows.column(6).flatten().to_numpy()
            ends = np.cumsum(rows.column(5).value_lengths().to_numpy()).tolist()
            at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
            has = own[at] == ids
            for seq, i, j in zip(rows.column(3).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                if has[i:j].any():
                    t = times[i:j][has[i:j]]
                    seqs.append(seq)
                    ns.append(int(t.sum()))
                    totals.append(t @ matrix[at[i:j][has[i:j]]])
        if seqs:
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(ns, pa.int64()), pa.array(totals, pa.list_(pa.float64()))], names=["seq", "n", "total"])


def means(docs: DataFrame, table: DataFrame, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """seq, n, mean: of documents (seq, tokens) the tokens that have a vector in the table (id, vector), and the mean of those vectors.

    A document asks for each of its ids once, block by block; a block of the table meets those that ask, in shares of about `share`
    documents, so that a block of frequent ids is no hot group.  Sums of blocks, a few for each document, are then added.  Documents
    without any such token have no row.  seq is a document's own.
    """
    shares = max(1, -(-docs.count() // share))
    needs = docs.select(F.col("seq").cast("bigint").alias("seq"), F.col("tokens").cast("array<bigint>").alias("tokens")).mapInArrow(_needs(block), "seq bigint, block bigint, ids array<bigint>, times array<bigint>")
    needs = needs.withColumn("share", F.pmod(F.xxhash64("seq"), F.lit(shares)))
    rows = table.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.expr(f"CAST(id AS bigint) DIV {block}").alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))).alias("share"))
    needs = needs.select("block", "share", F.lit(1).alias("asks"), F.col("seq").alias("id"), F.lit(None).cast("array<double>").alias("vector"), "ids", "times")
    none = F.lit(None).cast("array<bigint>")
    rows = rows.select("block", "share", F.lit(0).alias("asks"), "id", "vector", none.alias("ids"), none.alias("times"))
    met = rows.union(needs).repartition("block", "share").sortWithinPartitions("block", "share", "asks", "id")
    sums = met.mapInArrow(_gathered, "seq bigint, n bigint, total array<double>")
    each = sums.groupBy("seq").agg(F.sum("n").alias("n"), F.collect_list("total").alias("_t"))
    total = F.aggregate(F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0))), F.col("_t")[0], lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return each.select("seq", "n", F.transform(total, lambda x: x / F.col("n")).alias("mean"))
