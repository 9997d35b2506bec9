"""Top-k with ties and multinomial sampling over logits (row, token, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seeded


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Each row's tokens that aren't below its k-th logit: ties at the k-th stay."""
    return logits.withColumn("rank", F.rank().over(Window.partitionBy("row").orderBy(F.desc("logit"))).cast("bigint")).where(F.col("rank") <= k)


def softmax(logits: DataFrame, temperature: float) -> DataFrame:
    x = F.col("logit") / max(temperature, 1e-6)
    by = Window.partitionBy("row")
    e = F.exp(x - F.max(x).over(by))
    return logits.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(by)).drop("_e")


def draw(probabilities: DataFrame, seed: int) -> DataFrame:
    """row, token, u: inverse of the cumulative distribution at a uniform number seeded by row."""
    up_to = F.sum("p").over(Window.partitionBy("row").orderBy("token").rowsBetween(Window.unboundedPreceding, 0))
    u = F.conv(F.substring(seeded(F.col("row"), seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
    df = probabilities.withColumn("_cum", up_to).withColumn("u", u)
    inside = df.withColumn("_hit", F.when(F.col("_cum") > F.col("u"), F.col("token")))
    return inside.groupBy("row").agg(F.coalesce(F.min("_hit"), F.max("token")).alias("token"), F.max("u").alias("u"))
