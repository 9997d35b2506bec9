"""Training run logs: windows, epochs, perplexity, smoothing, summaries, resuming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.schedule import finite_mean
from quarry.operators.prefix import affine_scan
from quarry.sources.storage import file_system

LOG = "kind string, step bigint, epoch int, tokens bigint, lr double, loss double, grad_norm double, tokens_per_sec double, val_loss double, val_ppl double, train_loss double, train_ppl double, seconds double"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """run (its folder's name) and the records of */metrics.jsonl."""
    return spark.read.schema(LOG).json(path).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run"), "*")


def of_kind(log: DataFrame, kind: str) -> DataFrame:
    return log.where(F.col("kind") == kind)


def log_windows(steps: DataFrame, every: int, steps_per_epoch: int) -> DataFrame:
    """Means over windows of steps, from (run, step, loss, grad_norm): a window closes at each multiple of `every` and at a run's last step, and starts anew with an epoch."""
    df = steps.withColumn("epoch", F.expr(f"(step - 1) DIV {steps_per_epoch} + 1")).withColumn("_end", (F.ceil(F.col("step") / every) * every).cast("bigint"))
    total = F.max("step").over(Window.partitionBy("run"))
    df = df.withColumn("_total", total)
    grouped = df.groupBy("run", "epoch", "_end").agg(F.max("step").alias("step"), F.max("_total").alias("_total"), F.avg("loss").alias("loss"), finite_mean(F.col("grad_norm")).alias("grad_norm"), F.count("*").alias("n_steps"))
    return grouped.where((F.col("step") == F.col("_end")) | (F.col("step") == F.col("_total"))).select("run", "epoch", "step", "loss", "grad_norm", "n_steps")


def throughput(log: DataFrame, every: int, steps_per_epoch: int, tokens_per_step: int) -> DataFrame:
    """run, epoch, step, n_steps, tokens_per_sec of log windows, from (run, step, seconds, eval_seconds): time spent on evaluation isn't counted."""
    closed = log_windows(log.withColumns({"loss": F.col("seconds"), "grad_norm": F.col("eval_seconds")}), every, steps_per_epoch)
    spent = F.greatest((F.col("loss") - F.col("grad_norm")) * F.col("n_steps"), F.lit(1e-9))
    return closed.select("run", "epoch", "step", "n_steps", (F.col("n_steps") * tokens_per_step / spent).alias("tokens_per_sec"))


def epoch_history(steps: DataFrame, evals: DataFrame, steps_per_epoch: int) -> DataFrame:
    """run, epoch, step, seconds, train_loss, train_ppl, val_loss, val_ppl: means over an epoch's steps (run, step, loss, seconds) and its last evaluation (run, step, val_loss)."""
    epoch = F.expr(f"(greatest(step, 1L) - 1) DIV {steps_per_epoch} + 1").alias("epoch")
    train = steps.select("run", "step", "loss", "seconds", epoch).groupBy("run", "epoch").agg(F.max("step").alias("step"), F.sum("seconds").alias("seconds"), F.avg("loss").alias("train_loss"))
    val = evals.select("run", "step", "val_loss", epoch).groupBy("run", "epoch").agg(F.max_by("val_loss", "step").alias("val_loss"))
    df = train.join(val, ["run", "epoch"], "left")
    return df.select("run", "epoch", "step", "seconds", "train_loss", F.exp("train_loss").alias("train_ppl"), "val_loss", F.exp("val_loss").alias("val_ppl"))


def with_epochs(log: DataFrame, history: DataFrame, parameters: int) -> DataFrame:
    """One row for each run: its summary with its array of epochs, from logs and histories of runs."""
    epochs = F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "train_ppl", "val_loss", "val_ppl")))
    return summaries(log).drop("epochs").join(history.groupBy("run").agg(epochs.alias("epochs")), "run", "left").withColumn("parameters", F.lit(parameters))


def summary(name: str, log: DataFrame, history: DataFrame, parameters: int) -> DataFrame:
    """One row: that of one run."""
    return with_epochs(log.where(F.col("run") == name), history.where(F.col("run") == name), parameters)


def _pointer(path: str) -> str:
    return f"{path}/CURRENT"


def segments(spark: SparkSession, path: str) -> list[str]:
    """The folders that make the log now, in order; none if there is no log."""
    fs, at = file_system(spark, _pointer(path))
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        return [f"{path}/{name}" for name in bytes(stream.readAllBytes()).decode().split()]
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    """Make these folders the log: the pointer is written aside and takes the old one's place by one rename."""
    fs, at = file_system(spark, f"{_pointer(path)}-{uuid.uuid4().hex}")
    stream = fs.create(at)
    try:
        stream.write(bytearray("\n".join(names).encode()))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    ways = spark.sparkContext._gateway.new_array(options, 1)
    ways[0] = options.OVERWRITE
    to = spark._jvm.org.apache.hadoop.fs.Path(_pointer(path))
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(at, to, ways)


def _written(records: DataFrame, path: str) -> str:
    """A new segment of the log, which nothing points at yet."""
    name = f"segment-{uuid.uuid4().hex}"
    records.write.option("ignoreNullFields", True).json(f"{path}/{name}")
    return name


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """run and the records of a log."""
    schema = f"run string, {schema}"
    now = segments(spark, path)
    return spark.read.schema(schema).json(now) if now else spark.createDataFrame([], schema)


def append_log(records: DataFrame, path: str) -> None:
    """Add records (run, ...) to a log of JSON lines: a segment of their own, which is there as a whole or not at all.  One writer at a time."""
    spark = records.sparkSession
    _point(spark, path, [*(s.rsplit("/", 1)[1] for s in segments(spark, path)), _written(records, path)])


def resume_log(spark: SparkSession, path: str, at: DataFrame, schema: str = LOG) -> None:
    """Drop a log's records past each run's checkpoint (run, checkpoint), so that it can go on from there.

    What is kept is a new segment.  Stopped anywhere, the log is the old one or the new one; what nothing points at any more is removed at
    the end, or by the next resume.
    """
    kept = _written(resumed(read_log(spark, path, schema), at), path)
    _point(spark, path, [kept])
    fs, top = file_system(spark, path)
    for s in fs.listStatus(top):
        if s.getPath().getName() not in ("CURRENT", kept):
            fs.delete(s.getPath(), True)


def stage_seconds(log: DataFrame) -> DataFrame:
    """stage, n, seconds, share: wall-clock time by stage, from (stage, seconds)."""
    sums = log.groupBy("stage").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
    return sums.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy(F.lit(0))))  # a row for each stage


def weighted_perplexity(losses: DataFrame, by: list[str]) -> DataFrame:
    """Mean of losses weighted by their tokens, and its perplexity, from (loss, n)."""
    mean = F.sum(F.col("loss") * F.col("n")) / F.greatest(F.lit(1), F.sum("n"))
    return losses.groupBy(*by).agg(mean.alias("mean_loss"), F.exp(mean).alias("ppl"), F.sum("n").alias("n_tokens"))


def ema(df: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """by, order, value, ema: smoothed from the first value on.  order is a row's own number in its run.

    A step takes (1 - alpha) of what is there and adds alpha of the value, the first one the whole value: a scan of affine
    steps, folded in spans, so that a log of any length has many tasks.
    """
    first = df.groupBy(*by).agg(F.min(order).alias("_first"))  # a row for each run
    rows = df.select(*by, order, value).join(first, by)
    starts = F.col(order) == F.col("_first")
    factor, offset = F.when(starts, 0.0).otherwise(1 - alpha), F.col(value).cast("double") * F.when(starts, 1.0).otherwise(alpha)
    return affine_scan(rows, by, order, factor, offset, "ema").select(*by, order, value, "ema")


def past(df: DataFrame, share: float = 0.1, by: str = "run", tokens: str = "tokens") -> DataFrame:
    """Records past a share of their run's tokens."""
    return df.withColumn("_last", F.max(tokens).over(Window.partitionBy(by))).where(F.col(tokens) > share * F.col("_last")).drop("_last")


def axis(df: DataFrame, value: str, pad: float = 0.06) -> DataFrame:
    lo, hi = F.min(value), F.max(value)
    span = F.when(hi > lo, hi - lo).otherwise(1.0)
    return df.agg((lo - pad * span).alias("lo"), (hi + pad * span).alias("hi"))


def resumed(log: DataFrame, at: DataFrame) -> DataFrame:
    """The log without records past each run's checkpoint (run, checkpoint)."""
    return log.join(at, "run", "left").where(F.col("checkpoint").isNull() | (F.col("step") <= F.col("checkpoint"))).drop("checkpoint")


def summaries(log: DataFrame) -> DataFrame:
    """run, steps, tokens_seen, best_val_loss, median_rate (null without steps), last_val_loss, epochs."""
    is_ = lambda k: F.col("kind") == k
    return log.groupBy("run").agg(
        F.max("step").alias("steps"),
        F.max("tokens").alias("tokens_seen"),
        F.min(F.when(is_("eval"), F.col("val_loss"))).alias("best_val_loss"),
        F.median(F.when(is_("step"), F.col("tokens_per_sec"))).alias("median_rate"),
        F.max_by(F.when(is_("eval"), F.col("val_loss")), F.when(is_("eval"), F.col("step"))).alias("last_val_loss"),
        F.count_if(is_("epoch")).alias("epochs"),
    )
