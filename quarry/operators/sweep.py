"""One-factor sweeps: ranking, comparison with the baseline, spread, shares of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The published runs.  Name, factor, the factor's column, its value, parameters, steps, loss, perplexity, best periodic loss, tokens a second.
RUNS = (
    ("baseline", "baseline", None, None, 6846080, 768, 6.241682, 513.7221, 6.249395, 28105.8),
    ("lr_5e-4", "learning rate", "lr", 0.0005, 6846080, 768, 6.483419, 654.2037, 6.492515, 28098.7),
    ("lr_3e-3", "learning rate", "lr", 0.003, 6846080, 768, 6.247218, 516.5737, 6.250270, 28083.2),
    ("batch_16", "batch size", "batch_size", 16.0, 6846080, 1536, 6.176370, 481.2420, 6.177837, 47743.1),
    ("batch_64", "batch size", "batch_size", 64.0, 6846080, 384, 6.452544, 634.3142, 6.459653, 24168.5),
    ("layers_1", "layers", "n_layer", 1.0, 6647808, 768, 6.294556, 541.6152, 6.301353, 39603.5),
    ("embd_64", "embedding size", "n_embd", 64.0, 3324736, 768, 6.540781, 692.8278, 6.546248, 40769.8),
    ("embd_256", "embedding size", "n_embd", 256.0, 14478592, 768, 5.993559, 400.8388, 5.996585, 14971.8),
    ("seq_32", "sequence length", "seq_len", 32.0, 6833792, 3072, 6.108640, 449.7267, 6.118926, 29019.8),
    ("seq_64", "sequence length", "seq_len", 64.0, 6837888, 1536, 6.126738, 457.9401, 6.131955, 27592.4),
)
COLUMNS = ("name", "factor", "factor_key", "setting", "parameters", "steps", "val_loss", "val_ppl", "best_val_loss", "rate")
#: The baseline's settings by factor.
BASELINE = (("learning rate", "lr", 0.001), ("batch size", "batch_size", 32.0), ("layers", "n_layer", 2.0), ("embedding size", "n_embd", 128.0), ("sequence length", "seq_len", 128.0))


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(RUNS)], "ord int, name string, factor string, factor_key string, setting double, parameters bigint, steps bigint, val_loss double, val_ppl double, best_val_loss double, rate double").coalesce(1)


def factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BASELINE), "factor string, factor_key string, setting double").coalesce(1)


def ranking(runs: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.orderBy("val_loss", "ord")).cast("bigint")
    return runs.select("name", "val_loss", "val_ppl", place.alias("place"), (place == 1).alias("is_best"))


def best(runs: DataFrame) -> DataFrame:
    """The first run with the least loss."""
    return runs.agg(F.min_by("name", F.struct("val_loss", "ord")).alias("name"), F.min("val_loss").alias("val_loss"))


def against_baseline(runs: DataFrame) -> DataFrame:
    base = runs.where("name = 'baseline'").select(F.col("val_ppl").alias("base_ppl"))  # one row
    return runs.crossJoin(F.broadcast(base)).select("name", "val_ppl", ((F.col("val_ppl") / F.col("base_ppl") - 1) * 100).alias("change"))


def panels(runs: DataFrame, factors: DataFrame) -> DataFrame:
    """Each factor's runs, the baseline among them: factor, name, setting, val_loss, val_ppl, slot (baseline 0, then by setting)."""
    base = runs.where("name = 'baseline'").select("name", "val_loss", "val_ppl", F.lit(True).alias("is_base"))
    first = factors.crossJoin(F.broadcast(base)).select("factor", "name", "setting", "val_loss", "val_ppl", "is_base")
    rest = runs.where("name <> 'baseline'").select("factor", "name", "setting", "val_loss", "val_ppl", F.lit(False).alias("is_base"))
    slot = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("is_base"), "setting")) - 1
    return first.unionByName(rest).withColumn("slot", slot.cast("bigint"))


def spread(panels: DataFrame) -> DataFrame:
    """factor, best (name), spread: how much worse the worst run's perplexity is, in per cent."""
    worst = F.max_by("val_ppl", "val_loss") / F.min_by("val_ppl", "val_loss")
    return panels.groupBy("factor").agg(F.min_by("name", "val_loss").alias("best"), ((worst - 1) * 100).alias("spread"))


def parameter_shares(spark: SparkSession, vocab: int = 50_257, d: int = 128, layers: int = 2, context: int = 128) -> DataFrame:
    """component, n, share of a GPT with tied embeddings: four d x d matrices of attention and eight of the MLP a layer, with their biases and norms."""
    block = 12 * d * d + 13 * d
    parts = [("token_embedding", vocab * d), ("position_embedding", context * d), ("transformer_blocks", layers * block), ("final_layernorm", 2 * d)]
    df = spark.createDataFrame(parts, "component string, n bigint").coalesce(1)
    return df.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def unfinished(wanted: DataFrame, finished: DataFrame) -> DataFrame:
    return wanted.join(finished, "name", "left_anti")


def unknown(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.select("name").exceptAll(known.select("name"))


def findings(runs: DataFrame) -> DataFrame:
    """topic, text: what a sweep says, in numbers from its runs."""
    change = against_baseline(runs).join(runs.select("name", "factor", "val_loss", "rate", "parameters", "ord"), "name")
    top = change.agg(F.min_by(F.struct("name", "val_ppl", "change"), F.struct("val_loss", "ord")).alias("b")).select(F.lit("best").alias("topic"), F.format_string("%s has the least loss: perplexity %.1f, %.1f%% from the baseline", "b.name", "b.val_ppl", "b.change").alias("text"))
    by = change.where("factor <> 'baseline'").groupBy("factor").agg(F.min("change").alias("lo"), F.max("change").alias("hi"), F.max_by("name", "rate").alias("fast"), F.max("rate").alias("rate"))
    rest = by.select(F.col("factor").alias("topic"), F.format_string("perplexity moves by %.1f%% to %.1f%%; %s is the fastest with %.0f tokens a second", "lo", "hi", "fast", "rate").alias("text"))
    return top.unionByName(rest)
