"""Registered sources as a Spark data source: pinned revisions, a partition for each shard, reading on from a row of it.

pin() writes down what a source consists of (its Parquet files, their sizes and rows), under a revision that is a digest of
that.  spark.read.format("pinned") reads a revision, or refuses if a file isn't what was pinned.  Options: folder
(of pins), name, revision, skip (rows of each shard that have been read before), retries.  Only the columns of the schema
asked for are read (select(spark, ..., columns) asks for some), and row groups before `skip` aren't opened.

A shard whose reading fails is opened again, up to `retries` times with growing pauses, at the row after the last one given: nothing
is given twice, and nothing lost.  Beyond that the task fails, and Spark runs it again.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

ROWS = 4096


def _opened(path: str) -> tuple[pa.NativeFile, int]:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name), fs.get_file_info(name).size


def pin(spark: SparkSession, paths: list[str], folder: str, name: str) -> str:
    """Write down the Parquet files that make the source now; its revision.  What is said is a row for each file."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                f, size = _opened(path)
                with f:
                    file = pq.ParquetFile(f)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([file.metadata.num_rows], pa.int64())], names=["path", "size", "rows"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1000)))
    shards = [r.asDict() for r in files.mapInArrow(described, "path string, size bigint, rows bigint").collect()]
    said = json.dumps(sorted(shards, key=lambda s: s["path"]))
    revision = hashlib.sha256(said.encode()).hexdigest()[:16]
    fs, top = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{top}/{name}")
    with fs.open_output_stream(f"{top}/{name}/{revision}.json") as f:
        f.write(said.encode())
    return revision


class Shard(InputPartition):
    def __init__(self, path: str, size: int, rows: int, skip: int):
        self.path, self.size, self.rows, self.skip = path, size, rows, skip


class PinnedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pinned"

    def _shards(self) -> list[dict]:
        fs, top = pyarrow.fs.FileSystem.from_uri(self.options["folder"])
        with fs.open_input_stream(f"{top}/{self.options['name']}/{self.options['revision']}.json") as f:
            return json.loads(f.read())

    def schema(self) -> StructType:
        f, _ = _opened(self._shards()[0]["path"])
        with f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema: StructType) -> DataSourceReader:
        return PinnedReader(schema, self._shards(), self.options)


class PinnedReader(DataSourceReader):
    def __init__(self, schema: StructType, shards: list[dict], options):
        self.columns, self.shards = schema.fieldNames(), shards
        self.skip, self.retries = int(options.get("skip", 0)), int(options.get("retries", 3))
        #: A drill: a path; the first reader fails after `fail_after` rows, and leaves a file there.
        self.drill, self.fail_after = options.get("drill", None), int(options.get("fail_after", 0))

    def partitions(self) -> list[InputPartition]:
        return [Shard(s["path"], s["size"], s["rows"], self.skip) for s in self.shards]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        given, failed = shard.skip, 0
        while True:
            try:
                for b in self._rows(shard, given):
                    yield b
                    given += b.num_rows
                return
            except OSError:
                failed += 1
                if failed > self.retries:
                    raise
                time.sleep(min(30, 2**failed) if not self.drill else 0)

    def _rows(self, shard: Shard, first: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows from `first` on."""
        f, size = _opened(shard.path)
        with f:
            file = pq.ParquetFile(f)
            if size != shard.size or file.metadata.num_rows != shard.rows:
                raise ValueError(f"{shard.path} isn't what was pinned")
            at, groups = 0, []
            for k in range(file.num_row_groups):
                n = file.metadata.row_group(k).num_rows
                if at + n > first:
                    groups.append(k)
                elif not groups:
                    first -= n
                    continue
                at += n
            done = 0
            for b in file.iter_batches(batch_size=ROWS, row_groups=groups, columns=self.columns):
                rest = b.slice(min(b.num_rows, max(0, first - done)))
                done += b.num_rows
                if self.drill and done > first and self._fails(done - first):
                    raise OSError("drill")
                if rest.num_rows:
                    yield rest.select(self.columns)

    def _fails(self, rows: int) -> bool:
        fs, name = pyarrow.fs.FileSystem.from_uri(self.drill)
        if rows <= self.fail_after or fs.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
            return False
        with fs.open_output_stream(name):
            return True


def select(spark: SparkSession, folder: str, name: str, revision: str, columns: list[str] | None = None, **options) -> DataFrame:
    """A pinned revision; of its columns only those asked for are read."""
    spark.dataSource.register(PinnedSource)
    reader = spark.read.format("pinned").options(folder=folder, name=name, revision=revision, **options)
    if columns is None:
        return reader.load()
    whole = reader.load().schema
    return reader.schema(StructType([whole[c] for c in columns])).load()
