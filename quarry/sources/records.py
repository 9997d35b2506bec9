"""Raw records from tables and from JSON lines, and the registry of sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import digest, record_id
from quarry.sources.rotation import first_records
from quarry.sources.storage import dealt

RAW = "id string, source string, domain string, shard int, url string, title string, sha256 string, n_bytes bigint, text string"
CLEAN = "id string, source string, domain string, url string, title string, n_bytes bigint, text string"

#: Name, domain, license, weight of the registered sources; the first three are the default.
REGISTRY = (
    ("wikipedia", "encyclopedic", "CC-BY-SA-3.0 / GFDL", 1 / 3),
    ("cc_news", "news", "unknown (CC-News derivative); research use only", 1 / 3),
    ("fineweb", "general_web", "ODC-BY-1.0", 1 / 3),
    ("c4_noclean", "general_web", "ODC-BY-1.0", 1 / 3),
)
DEFAULT = ("wikipedia", "cc_news", "fineweb")


def registry(spark: SparkSession, more: tuple[tuple[str, str, str, float], ...] = ()) -> DataFrame:
    """The registered sources and others like them: a new source is a row."""
    return spark.createDataFrame([*REGISTRY, *more], "name string, domain string, license string, weight double")


def with_source(records: DataFrame, registry: DataFrame) -> DataFrame:
    """records with the license of their source; what isn't registered has none."""
    return records.join(F.broadcast(registry.select(F.col("name").alias("source"), "license")), "source", "left")  # a row for each source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, order: str | None = None) -> DataFrame:
    """A table whose texts are much work; what is dealt out comes in ranges of `order`, if that is given."""
    return dealt(table(spark, sf_dir, name), order)


def raw_records(df: DataFrame) -> DataFrame:
    """seq and the columns of RAW, from (seq, n, source, domain, shard, url, title, text)."""
    return df.select("seq", record_id(F.col("source"), F.col("n")).alias("id"), "source", "domain", "shard", "url", "title", digest(F.col("text")).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"), "text")


def documents(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    none = F.lit(None).cast("string")
    return raw_records(texts(spark, sf_dir, "documents", "doc_id" if in_order else None).select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("n"), "source", F.col("lang").alias("domain"), (F.col("doc_id") % 16).cast("int").alias("shard"), none.alias("url"), none.alias("title"), "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(texts(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("page_id").alias("n"), F.lit("pages").alias("source"), F.lit("general_web").alias("domain"), (F.col("page_id") % 16).cast("int").alias("shard"), "url", F.lit(None).cast("string").alias("title"), F.col("html").alias("text")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    none = F.lit(None).cast("string")
    return raw_records(texts(spark, sf_dir, "conversations").select(seq, seq.alias("n"), F.lit("conversations").alias("source"), F.col("role").alias("domain"), (F.col("conv_id") % 16).cast("int").alias("shard"), none.alias("url"), none.alias("title"), "text"))


def in_shards(df: DataFrame, seq: str, most_bytes: int) -> DataFrame:
    """df with file: records in sequence, a new file wherever the one before has reached `most_bytes` of JSON lines.

    A file is as large as that and one record at most.  df is read twice, the first time for the lengths of its lines; the files'
    first numbers then go to the records.
    """
    size = (F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})) + 1).cast("bigint")
    firsts = np.array(first_records(df.select(F.col(seq).alias("seq"), size.alias("size")), most_bytes), np.int64)

    @F.pandas_udf("bigint")
    def file_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, numbers.to_numpy(), side="right") - 1)

    return df.withColumn("file", file_of(F.col(seq).cast("bigint")))


def write_jsonl(df: DataFrame, path: str, seq: str, most_bytes: int = 256 << 20, overwrite: bool = False) -> None:
    """Gzipped JSON lines in folders file=0, file=1, ..., each one file in sequence (rotated by bytes); refuses to overwrite unless told to."""
    dealt = in_shards(df, seq, most_bytes).repartition(F.col("file")).sortWithinPartitions("file", seq)
    dealt.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("file").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW, limit: int | None = None) -> DataFrame:
    """Records with the file they come from and their place in it (ascending, with gaps); a missing path is an error at once.

    limit: only the first records in the order of files and places.
    """
    df = spark.read.schema(f"{schema}, file bigint").json(path).withColumn("place", F.monotonically_increasing_id())
    return df if limit is None else df.orderBy("file", "place").limit(limit)


#: Files up to this size are read as one value.
WHOLE = 256 << 20
#: Bytes of a longer file that are read at a time.
RANGE = 8 << 20


def digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """path, n_bytes and SHA-256 of each file; of a long file a task holds one range of bytes at a time."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    # the content isn't asked for, so it isn't read here
    large = files.where(F.col("length") > whole).select("path", "length")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(at)
                sha, done = hashlib.sha256(), 0
                with fs.open_input_stream(name) as f:
                    while part := f.read(RANGE):
                        sha.update(part)
                        done += len(part)
                if done != n:
                    raise OSError(f"{at}: {done} bytes of {n}")
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n], pa.int64()), pa.array([sha.hexdigest()])], names=["path", "n_bytes", "sha256"])

    return small.union(large.mapInArrow(streamed, "path string, n_bytes bigint, sha256 string"))


def shards(files: DataFrame) -> DataFrame:
    """path, n_bytes, sha256, files of each table of digests(): a table is a shard, whether it is one file or a folder of them.

    The digest of a table of one file is the file's, else that of its files' digests, a line each, in the order of their paths.
    """
    folder = F.regexp_extract("path", r"^(.*\.parquet)/[^/]*$", 1)
    each = files.groupBy(F.when(folder == "", F.col("path")).otherwise(folder).alias("path")).agg(F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("path", "n_bytes", "sha256"))).alias("files"))
    whole = F.sha2(F.array_join("files.sha256", "\n").cast("binary"), 256)
    return each.select("path", "n_bytes", F.when(F.size("files") == 1, F.col("files")[0]["sha256"]).otherwise(whole).alias("sha256"), "files")
