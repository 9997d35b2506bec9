"""Ordered exact dedup by survivor bitmaps: of rows with the same key the first in sequence stays.

What is known of each key, its least sequence number, is combined from key and number alone.  The survivors' numbers
become bitmaps (a bucket of 32,768 numbers each), and rows ask the bitmap of their number's bucket: nothing but keys
and numbers is shuffled, however wide the rows are.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.storage import materialise

#: A bitmap's size, and the bytes of bitmaps that are broadcast at once; rows of more are marked range by range.
BITMAP = 4096
MOST = 64 << 20


def survivors(df: DataFrame, key: str, seq: str) -> DataFrame:
    """bucket, bits: bitmaps of the least number of each key; null keys have none.

    seq is a row's own number.  Of df only key and seq are read; the numbers are dealt out by bucket before they
    become bits, so that no task holds bitmaps of the whole sequence.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("_seq"))
    bucket = F.bitmap_bucket_number("_seq").alias("bucket")
    return bitmaps(firsts.select(bucket, F.col("_seq")))


def bitmaps(numbers: DataFrame) -> DataFrame:
    """bucket, bits from (bucket, _seq)."""
    dealt = numbers.repartition(F.col("bucket"))
    return materialise(dealt.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_seq")).alias("bits")))


def has_bit(bits: Column, place: Column) -> Column:
    """Is the bit at this place (from 0) of a bitmap set?  Null bits: no."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.call_function("shiftright", byte, (place % 8).cast("int")) % 2) == 1, F.lit(False))


def _ranges(found: DataFrame, most: int) -> list[tuple[int | None, int | None]]:
    """Ranges [from, to) of buckets, of about `most` bytes of bitmaps each; None: without end."""
    n = -(-found.count() * BITMAP // most)
    if n <= 1:
        return [(None, None)]
    cuts = found.agg(F.percentile_approx("bucket", [k / n for k in range(1, n)], 10 * n).alias("c")).first()["c"]
    return list(pairwise([None, *sorted(set(cuts)), None]))


def mark(df: DataFrame, found: DataFrame, seq: str, out: str, most: int = MOST) -> DataFrame:
    """df with `out`: is the row's number in the bitmaps?

    Bitmaps go to the rows.  If there are more than `most` bytes of them, rows are taken in ranges of numbers, each with its own
    bitmaps: a filter on the number that reaches the scan.
    """
    bucket = F.bitmap_bucket_number(F.col(seq))
    parts = []
    for a, b in _ranges(found, most):
        rows, some = df, found
        if a is not None:
            rows, some = rows.where(F.col(seq) > (a - 1) * 8 * BITMAP), some.where(F.col("bucket") >= a)
        if b is not None:
            rows, some = rows.where(F.col(seq) <= (b - 1) * 8 * BITMAP), some.where(F.col("bucket") < b)
        side = F.broadcast(some.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
        met = rows.join(side, bucket == F.col("_bucket"), "left")
        parts.append(met.withColumn(out, has_bit(F.col("_bits"), F.bitmap_bit_position(F.col(seq)))).drop("_bucket", "_bits"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def mark_first(df: DataFrame, key: str, seq: str, out: str) -> DataFrame:
    """df with `out`: is the row the first of its key?  Null where the key is null.  seq is a row's own: no two rows have the same.

    df is read twice, the first time for key and seq only.
    """
    return mark(df, survivors(df.select(key, seq), key, seq), seq, out).withColumn(out, F.when(F.col(key).isNotNull(), F.col(out)))
