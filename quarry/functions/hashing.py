"""Content digests, keys, ids and the hash split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def key(digest: Column) -> Column:
    """The first 64 bits of a digest, in hexadecimal: for a dedup only equality matters."""
    return F.substring(digest, 1, 16)


def record_id(source: Column, n: Column) -> Column:
    """source:00000007; numbers of nine digits and more keep them all."""
    digits = n.cast("string")
    return F.concat(source, F.lit(":"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def bucket(text: Column, n: int) -> Column:
    """A number below n from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(text), 1, 8), 16, 10).cast("bigint") % n


def split_for(id: Column, val_per_mille: int = 5) -> Column:
    """train or val, by id alone: the same for any order, run or partitioning."""
    return F.when(bucket(id, 1000) < val_per_mille, "val").otherwise("train")


def seeded(id: Column, seed: Column | int) -> Column:
    """A sort key for reproducible orders and samples."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return digest(F.concat_ws(":", seed.cast("string"), id.cast("string")))
