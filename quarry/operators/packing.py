"""Token streams: packing into blocks, shifted pairs, page windows, batches and padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.functions.hashing import digest
from quarry.sources.storage import discard, materialise

BLOCK = 1024
PAGE = 1024
EOS = 65_535
IGNORED = -100


def word_tokens(words: Column) -> Column:
    """Stand-in ids that fit 16 bits, from words' first and last letters and lengths, and an end-of-document id: for plans that SQL must be able to check."""
    return F.concat(F.transform(words, lambda w: F.ascii(w) * 512 + F.ascii(F.right(w, F.lit(1))) * 4 + F.length(w) % 4), F.array(F.lit(EOS)))


#: The end of a document among ids of 16 bits, none of which it is.
DIGEST_EOS = 65_536


def digest_tokens(words: Column) -> Column:
    """Ids of whole words, by the first 16 bits of their SHA-256, and an end-of-document id beyond them: SQL can make them too."""
    return F.concat(F.transform(words, lambda w: F.conv(F.substring(digest(w), 1, 4), 16, 10).cast("int")), F.array(F.lit(DIGEST_EOS)))


def pack(docs: DataFrame, block: int = BLOCK, by: str = "split", seq: str = "seq", tokens: str = "tokens", ahead: int = 0) -> DataFrame:
    """by, block_id, tokens: whole blocks of each split's documents one after the other; the rest of a split is dropped.

    Documents are written once, in partitions that are ranges of the sequence, with the tokens before each in its
    partition; the tokens before a partition come from the partitions' sums.  Blocks are then cut where the
    documents lie.  Only what a task has of the blocks at the edges of a stretch of documents is shuffled: about two blocks a task
    and split, however many tokens there are.  Documents are shuffled before only if their partitions aren't ranges as they come.
    ahead: each block has so many tokens (up to `block`) of the next whole one besides; the last block has none and is dropped.
    """
    table, edges = _in_ranges(docs.select(F.col(by).cast("string").alias(by), seq, F.col(tokens).alias("tokens")), by, seq)
    whole = edges.groupBy(by).agg(F.expr(f"sum(_n) DIV {block}").alias("_whole"))  # a row for each split
    # edges have a row for each partition and split
    placed = table.join(F.broadcast(edges.select(by, "_part", "_base")), [by, "_part"]).select(by, (F.col("_base") + F.col("_before")).alias("start"), "tokens")
    cut = placed.mapInArrow(_cut(by, block, ahead), f"{by} string, block_id bigint, place int, tokens array<int>")
    full = F.size("tokens") == block + ahead
    met = cut.where(~full).groupBy(by, "block_id").agg(F.sort_array(F.collect_list(F.struct("place", "tokens"))).alias("_p"))
    met = met.select(by, "block_id", F.flatten(F.col("_p.tokens")).alias("tokens")).where(full)
    blocks = cut.where(full).select(by, "block_id", "tokens").union(met)
    return blocks.join(F.broadcast(whole), by).where(F.col("block_id") < F.col("_whole") - (1 if ahead else 0)).drop("_whole")


def _in_ranges(docs: DataFrame, by: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(by, seq, tokens, _part, _before) in a table whose partitions are ranges of seq in each split, and (by, _part, _n, _base), a row for each partition and split.

    _before, _base: the tokens of the split before the document in its partition, and before the partition.
    """

    def written(ranged: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = ranged.sortWithinPartitions(by, seq).withColumn("_part", F.spark_partition_id().cast("bigint"))
        table = materialise(rows.mapInArrow(_summed, StructType([*rows.schema.fields, StructField("_before", LongType())])))
        edges = table.groupBy(by, "_part").agg(F.min(seq).alias("_first"), F.max(seq).alias("_last"), F.sum(F.greatest(F.size("tokens"), F.lit(0)).cast("bigint")).alias("_n"))
        in_order = Window.partitionBy(by).orderBy("_first", "_part")
        before = F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return table, materialise(edges.withColumns({"_overlaps": F.lag("_last").over(in_order) >= F.col("_first"), "_base": before}))

    table, edges = written(docs)
    if edges.where("_overlaps").isEmpty():
        return table, edges
    ranged = written(table.select(by, seq, "tokens").repartitionByRange(by, seq))
    discard(table, edges)
    return ranged


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds _before to rows (split, seq, tokens, ...) of a partition, sorted by split and sequence."""
    split, total = None, 0
    for b in batches:
        sizes = _sizes(b.column(2))
        before = np.cumsum(sizes) - sizes
        codes = b.column(0).dictionary_encode()
        names = codes.dictionary.to_pylist()
        code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(code)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
            if a == z:
                continue
            own = names[code[a]] if code[a] >= 0 else None
            if own != split:
                split, total = own, 0
            before[a:z] += total - before[a]
            total = int(before[z - 1] + sizes[z - 1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], names=[*b.schema.names, "_before"])


class _Stretch:
    """Documents that follow each other: blocks before `first` begin before them, those from it on are whole as soon as their tokens are here."""

    def __init__(self, start: int, block: int, ahead: int):
        self.block, self.ahead, self.at = block, ahead, start
        self.heads = range(max(0, (start - ahead) // block), -(-start // block))
        self.next = -(-start // block)
        self.held = np.zeros(0, np.int32)

    def pieces(self, blocks: range, start: int, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """block, place in it, tokens: what these tokens are of the blocks."""
        for k in blocks:
            a, z = max(start, k * self.block), min(start + len(ids), (k + 1) * self.block + self.ahead)
            if a < z:
                yield k, a - k * self.block, ids[a - start : z - start]

    def take(self, ids: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray]], int, np.ndarray]:
        """Pieces of the first blocks; the number of the first whole block; whole blocks, a row each."""
        found = list(self.pieces(self.heads, self.at, ids))
        self.held = np.concatenate((self.held, ids[max(0, self.next * self.block - self.at - len(self.held)) :])) if len(self.held) else ids[max(0, self.next * self.block - self.at) :]
        self.at += len(ids)
        n = max(0, (len(self.held) - self.ahead) // self.block)
        if not n:
            return found, self.next, np.zeros((0, self.block + self.ahead), np.int32)
        rows = np.lib.stride_tricks.sliding_window_view(self.held, self.block + self.ahead)[:: self.block][:n]
        self.held, first, self.next = self.held[n * self.block :].copy(), self.next, self.next + n
        return found, first, rows

    def rest(self) -> list[tuple[int, int, np.ndarray]]:
        return list(self.pieces(range(self.next, -(-self.at // self.block)), self.next * self.block, self.held))


#: Blocks of a record batch.
_BATCH = 1024


def _cut(by: str, block: int, ahead: int):
    """From rows (split, start, tokens) whole blocks with what is ahead of them and, where the rows don't go on, pieces of blocks."""

    def batch(split: str, ids: np.ndarray, places: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([split] * len(sizes), pa.string()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), lists], names=[by, "block_id", "place", "tokens"])

    def some(split: str, found: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            ids, places, tokens = zip(*found, strict=True)
            yield batch(split, np.array(ids), np.array(places), np.array([len(t) for t in tokens]), np.concatenate(tokens))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Stretch] = {}
        for b in batches:
            splits = b.column(0).dictionary_encode()
            for code, split in enumerate(splits.dictionary.to_pylist()):
                rows = b.filter(pc.equal(splits.indices, code)) if len(splits.dictionary) > 1 else b
                starts, sizes = rows.column(1).to_numpy(), _sizes(rows.column(2))
                ids = rows.column(2).flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                cuts = (np.flatnonzero(starts[1:] != (starts + sizes)[:-1]) + 1).tolist()
                for a, z in zip([0, *cuts], [*cuts, len(starts)], strict=True):
                    if split not in open_ or open_[split].at != starts[a]:
                        if split in open_:
                            yield from some(split, open_[split].rest())
                        open_[split] = _Stretch(int(starts[a]), block, ahead)
                    found, first, whole = open_[split].take(ids[int(ends[a] - sizes[a]) : int(ends[z - 1])])
                    yield from some(split, found)
                    for k in range(0, len(whole), _BATCH):
                        part = whole[k : k + _BATCH]
                        yield batch(split, first + k + np.arange(len(part)), np.zeros(len(part)), np.full(len(part), block + ahead), part.reshape(-1))
        for split, stretch in open_.items():
            yield from some(split, stretch.rest())

    return work


def pairs(blocks: DataFrame, block: int = BLOCK, by: str = "split") -> DataFrame:
    """split, block_id, input, label from blocks packed with one token ahead: labels are the next tokens, across block edges; the last block has no next and gives no pair."""
    return blocks.select(by, "block_id", F.slice("tokens", 1, block).alias("input"), F.slice("tokens", 2, block).alias("label"))


def pair_at(pairs: DataFrame, index: int, id: str = "block_id"):
    """The pair of a number from 0, or of a negative one from the end; IndexError beyond.  pairs are those of one split."""
    n = pairs.select(id).count()
    if not -n <= index < n:
        raise IndexError(f"pair {index} of {n}")
    return pairs.where(F.col(id) == index % n).first()


def windows(blocks: DataFrame, length: int, page: int = PAGE, by: str = "split") -> DataFrame:
    """split, page_id, window_id, input, label of all windows of `length` in each page, from pages packed with one token ahead."""
    if page % length:
        raise ValueError(f"a page of {page} isn't a multiple of {length}")
    df = blocks.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(page // length - 1))))
    return df.select(by, F.col("block_id").alias("page_id"), "window_id", F.slice("tokens", F.col("window_id") * length + 1, length).alias("input"), F.slice("tokens", F.col("window_id") * length + 2, length).alias("label"))


def batch_ids(df: DataFrame, order: list[Column | str], size: int, drop_last: bool, rank: str | None = None) -> DataFrame:
    """df with batch_id: rows in order, `size` at a time.  rank: a column that is the row's number already, which saves the sort in one task."""
    n = F.col(rank) if rank else F.row_number().over(Window.orderBy(*order)) - 1
    df = df.withColumn("batch_id", F.floor(n / size).cast("bigint"))
    if not drop_last:
        return df
    full = df.groupBy("batch_id").agg(F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")
    return df.join(full, "batch_id")


def padded(df: DataFrame, max_length: int, pad: int = EOS, batch: str = "batch_id", tokens: str = "tokens") -> DataFrame:
    """df with input_ids, attention_mask and labels (-100 where padded, not shifted), as wide as the widest of the batch."""
    df = df.withColumn("_t", F.slice(tokens, 1, max_length)).withColumn("_w", F.max(F.size("_t")).over(Window.partitionBy(batch)))
    more = F.col("_w") - F.size("_t")
    return df.withColumns(
        {
            "input_ids": F.concat("_t", F.array_repeat(F.lit(pad), more)),
            "attention_mask": F.concat(F.transform("_t", lambda _: F.lit(1)), F.array_repeat(F.lit(0), more)),
            "labels": F.concat("_t", F.array_repeat(F.lit(IGNORED), more)),
        }
    ).drop("_t", "_w")


def pad_waste(df: DataFrame, max_length: int, batch: str = "batch_id", tokens: str = "tokens") -> DataFrame:
    """batch_id, pad_fraction."""
    n = F.least(F.size(tokens), F.lit(max_length))
    return df.groupBy(batch).agg((1 - F.sum(n) / (F.count("*") * F.max(n))).alias("pad_fraction"))


def worker_share(blocks: DataFrame, n_workers: int, id: str = "block_id") -> DataFrame:
    return blocks.withColumn("worker", F.pmod(F.col(id), F.lit(n_workers)))
