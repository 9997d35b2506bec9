"""Shared storage between the steps of a plan, and inputs of few files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An input below this size for each core may be dealt out; beyond, it surely has splits enough.
SPLIT_BYTES = 128 << 20
#: Spark's own limit (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one of the driver's own, if all tasks run in the driver (as in tests); else an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, key: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    It cuts the lineage: executors lost later don't cause the work before it to be done again, and what reads it
    twice doesn't make it twice.  The table goes when the driver ends, or before that by discard().
    With a key it lies in as many buckets of that column as Spark shuffles into: what groups by the key reads it where it
    lies, and only the other side of a cogroup or join is shuffled.
    """
    spark = df.sparkSession
    name = f"quarry-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    to = df.write.option("compression", "zstd")
    if key is None:
        to.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        name = name.replace("-", "_")
        n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        to.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the name alone: files outside the warehouse stay, and out knows them and their buckets
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what materialise() wrote, once nothing that is still to be computed reads it."""
    for t in tables:
        fs, at = file_system(t.sparkSession, t._quarry_path)
        fs.delete(at, True)


def too_few_files(df: DataFrame) -> int:
    """The number of cores, if df is a small table of fewer files than that, else 0.  A file of one row group is one task's work otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SPLIT_BYTES:
        return 0
    return cores


def dealt(df: DataFrame, order: str | None = None) -> DataFrame:
    """df as it is, or, if it is a small table of too few files, dealt out to all cores: in turn, or in ranges of a column."""
    if not (n := too_few_files(df)):
        return df
    # the filter, always true and not deterministic, keeps expressions over the rows from being moved to before the shuffle
    return (df.repartitionByRange(n, order) if order else df.repartition(n)).where(F.monotonically_increasing_id() >= 0)
