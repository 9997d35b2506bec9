"""What several operators of this folder use: inputs, shared storage and sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.storage import dealt, discard, materialise, shared_folder

__all__ = ["NULL_ID", "dealt", "discard", "groups_for", "materialise", "shared_folder", "small_side", "table", "texts"]

#: Stands for a null doc_id where documents are ordered: after all others.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are much work, for operators to which the order of rows means nothing."""
    return dealt(table(spark, sf_dir, name))


def small_side(table: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """A materialised table, to be the hashed side of a join if a partition's share of it surely fits in memory; else Spark sorts, and can spill."""
    share = table.count() * row_bytes / int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.hint("shuffle_hash") if share <= most else table


def groups_for(n_bytes: int, each: int, least: int = 8) -> int:
    """How many groups of about `each` bytes hold n_bytes."""
    return max(least, -(-n_bytes // each))
