"""Flat token files: the ids of documents one after the other, each followed by a separator, in blocks.

A file holds a run of documents in a stable order: that of the stored table (path, then row) where documents are read
from Parquet, else that of their ids and, of equal ids, of their texts' hashes.  Where runs begin depends on the splits of the
input; the order of files (path, first), and so the stream that they make up together, doesn't.  Blocks of
a file have the same number of tokens, but for the last.  Ids are unsigned 16-bit, little-endian; a tokenizer with
more ids is refused.  Null texts are empty: a separator alone.  Null ids stay null (and come last).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.tokens import encoder
from quarry.sources.storage import too_few_files

#: <|endoftext|> of word_bpe_49k; texts are encoded so that it never comes from a text.
SEPARATOR = 49407

_NAMES = [("file", pa.int64()), ("path", pa.string()), ("first", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("ends", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))]
_SCHEMA = "file bigint, path string, first bigint, block bigint, n bigint, tokens binary, ends array<bigint>, starts array<bigint>, at array<bigint>"


def separator_of(tokenizer: str, token: str = "<|endoftext|>") -> int:
    """The id of the end-of-document token, which must exist; all ids must fit 16 bits."""
    t = encoder(tokenizer, True).tokenizer
    if t.get_vocab_size() > 1 << 16:
        raise ValueError(f"{t.get_vocab_size()} ids don't fit 16 bits")
    if (id := t.token_to_id(token)) is None:
        raise ValueError(f"no token {token!r}")
    return id


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, path, row: in a stable order within partitions; (path, row) orders runs of rows."""
    plan = docs._jdf.queryExecution().analyzed().toString()
    nodes = re.findall(r"(?m)^[ :+|-]*(\w+)", plan)
    if {*nodes} <= {"Project", "Filter", "SubqueryAlias", "Relation"} and "] parquet" in plan:
        at = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", at["file_path"].alias("path"), at["row_index"].alias("row"))
        # few files: more tasks than those, with the same order
        return rows.repartitionByRange(n, "path", "row").sortWithinPartitions("path", "row") if (n := too_few_files(docs)) else rows
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    docs = docs.select("doc_id", "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return docs.select("doc_id", "text", F.lit("").alias("path"), F.monotonically_increasing_id().alias("row"))


def write(docs: DataFrame, tokenizer: str, block: int) -> DataFrame:
    """file, path, first (what orders files), block (from 0 in each file), n (tokens), tokens, ends (doc_ids of the documents that end in it, in order), starts (likewise), at (where they start)."""
    separator = separator_of(tokenizer)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True).ids
        file, nth, size = TaskContext.get().partitionId() << 32, 0, 0
        path, first, row = None, 0, -1
        held: list[np.ndarray] = []  # tokens of the open block and after it
        marks: list[tuple[int, int, int | None]] = []  # tokens from the open block's start to the document's start and end

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, marks, nth, size
            flat = np.concatenate(held) if held else np.zeros(0, "<u2")
            rows = []
            full = -(-size // block) if last else size // block
            ends: list[list] = [[] for _ in range(full + 1)]
            starts: list[list] = [[] for _ in range(full + 1)]
            at: list[list] = [[] for _ in range(full + 1)]
            for a, b, i in marks:
                if a >= 0:
                    starts[min(full, a // block)].append(i)
                    at[min(full, a // block)].append(a % block)
                ends[min(full, (b - 1) // block)].append(i)
            for k in range(full):
                part = flat[k * block : (k + 1) * block]
                rows.append((file, path, first, nth + k, len(part), part.tobytes(), ends[k], starts[k], at[k]))
            done = full * block
            marks = [(a - done if a >= done else -1, b - done, i) for a, b, i in marks if b > done]
            held, size, nth = [flat[done:]], max(0, size - done), nth + full
            # a document that started in a block already cut only ends later
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[k : k + 64], strict=True), _NAMES, strict=True)], names=[n for n, _ in _NAMES])

        for b in it:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                texts = [t or b"" for t in some.column(1).cast(pa.large_binary()).to_pylist()]
                for i, ids, p, r in zip(some.column(0).to_pylist(), encode(texts), some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    if p != path or r < row:
                        if size:
                            yield from cut(True)
                        file, path, first, nth, size, held, marks = file + 1, p, r, 0, 0, [], []
                    row = r
                    own = np.append(np.frombuffer(ids, "<u4"), separator).astype("<u2")
                    marks.append((size, size + len(own), i))
                    held.append(own)
                    size += len(own)
                if size >= max(block, 1 << 20):
                    yield from cut(False)
        if size:
            yield from cut(True)

    return _in_order(docs).mapInArrow(work, _SCHEMA)


def bases(flat: DataFrame) -> DataFrame:
    """file, tokens0, docs0: the tokens and documents in all files before it.  A row for each file, and so for each split of the input."""
    files = flat.groupBy("file", "path", "first").agg(F.sum("n").alias("tokens"), F.sum(F.size("ends")).alias("docs"))
    before = Window.orderBy("path", "first").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("tokens", "docs")])


#: Tokens that one read of a file from elsewhere takes, about.
READ = 1 << 23


def of_files(spark, path: str, block: int) -> DataFrame:
    """file (a number by its path), path, block, n, tokens of flat files of any length written elsewhere, read by ranges of bytes.

    Spark lists the files; tasks read their ranges by pyarrow's file systems, so the path's scheme must be one of those.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("file"), "length")
    step = 2 * block * max(1, READ // block)
    ranges = files.where("length > 0").select("file", "path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("at"))
    ranges = ranges.repartition(F.col("path"), F.col("at"))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file, p, length, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, p = pyarrow.fs.FileSystem.from_uri(p)
                with fs.open_input_file(p) as f:
                    content = f.read_at(min(step, length - at), at)
                for k in range(0, len(content), 2 * block):
                    part = content[k : k + 2 * block]
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([(at + k) // (2 * block)]), pa.array([len(part) // 2]), pa.array([part], pa.binary())], names=["file", "block", "n", "tokens"])

    return ranges.mapInArrow(work, "file bigint, block bigint, n bigint, tokens binary")
