"""Flat files of token ids of 16 bits (or 32): whole blocks of a split, so many a file, at places that follow from their numbers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a file.
PER_FILE = 4096


def write_blocks(blocks: DataFrame, folder: str, block: int, per_file: int = PER_FILE, by: str = "split", bits: int = 16) -> DataFrame:
    """Write blocks (split, block_id, tokens) to folder/<split>-<number>.bin; path, n_blocks, n_bytes of each file.

    Block i is at byte (i % per_file) * block * bits / 8 of file i div per_file.  A file is complete or absent; a task that runs
    again writes the same bytes.  An id beyond 16 bits (or 32) is an error.
    """
    kind = np.dtype(f"<u{bits // 8}")

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        split, number = key[0].as_py(), key[1].as_py()
        rows = rows.sort_by("block_id")
        ids = rows["tokens"].combine_chunks().flatten().to_numpy()
        if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(kind).max):
            raise ValueError(f"{ids.max()} doesn't fit {bits} bits")
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(top)
        at = f"{top}/{split}-{number:05d}.bin"
        part = f"{at}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            f.write(ids.astype(kind).tobytes())
        fs.move(part, at)
        return pa.table({"path": [at], "n_blocks": pa.array([rows.num_rows], pa.int64()), "n_bytes": pa.array([kind.itemsize * len(ids)], pa.int64())})

    files = blocks.select(by, F.expr(f"block_id DIV {per_file}").alias("_file"), "block_id", "tokens").groupBy(by, "_file")
    done = files.applyInArrow(work, "path string, n_blocks bigint, n_bytes bigint")
    return blocks.sparkSession.createDataFrame([tuple(r) for r in done.collect()], done.schema)  # a row for each file


def read_blocks(spark: SparkSession, folder: str, block: int, per_file: int = PER_FILE, bits: int = 16) -> DataFrame:
    """split, block_id, tokens of the files that write_blocks wrote with the same `bits`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    name = F.regexp_extract("path", r"([^/]*)-(\d+)\.bin$", 1), F.regexp_extract("path", r"([^/]*)-(\d+)\.bin$", 2).cast("bigint")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for split, number, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(content, f"<u{bits // 8}").reshape(-1, block)
                for a in range(0, len(ids), 256):
                    some = ids[a : a + 256]
                    at = np.arange(a, a + len(some)) + number * per_file
                    yield pa.RecordBatch.from_arrays([pa.array([split] * len(some)), pa.array(at), pa.array(list(some.astype(np.int32)), pa.list_(pa.int32()))], names=["split", "block_id", "tokens"])

    return files.select(name[0].alias("split"), name[1].alias("number"), "content").mapInArrow(work, "split string, block_id bigint, tokens array<int>")
