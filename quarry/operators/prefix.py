"""Running sums and row numbers without a single-partition shuffle."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.storage import materialise


def running_sum(df: DataFrame, value: str | dict[str, str], seq: str, out: str = "", by: list[str] | None = None, span: int = 256, levels: int = 3) -> DataFrame:
    """df with `out`: the sum of `value` over the rows before this one, by sequence number, in each group.

    Several values at once are given with their outs.
    In levels: sums of spans of sequence numbers, of spans of those, and so on, then rows within a span; the highest
    level has a row for each span ** (levels - 1) numbers only.  df is read twice, so it should be a table or
    cheap to make.
    """
    by, values = by or [], {value: out} if isinstance(value, str) else value
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = df.withColumn("_span", F.floor(F.col(seq) / span))
    spans = df.groupBy(*by, "_span").agg(*[F.sum(v).alias(f"_sum{levels}_{k}") for k, v in enumerate(values)])
    if levels > 2:
        spans = running_sum(spans.withColumnRenamed("_span", "_upper"), {f"_sum{levels}_{k}": f"_base{levels}_{k}" for k in range(len(values))}, "_upper", by=by, span=span, levels=levels - 1).withColumnRenamed("_upper", "_span")
    else:
        upper = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumns({f"_base{levels}_{k}": zero(F.sum(f"_sum{levels}_{k}").over(upper)) for k in range(len(values))})
    lower = Window.partitionBy(*by, "_span").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    met = df.join(spans, [*by, "_span"]).withColumns({o: F.col(f"_base{levels}_{k}") + zero(F.sum(v).over(lower)) for k, (v, o) in enumerate(values.items())})
    return met.drop("_span", *[f"_{x}{levels}_{k}" for x in ("sum", "base") for k in range(len(values))])


def affine_scan(df: DataFrame, by: list[str], seq: str, factor: Column, offset: Column, out: str, span: int = 256, levels: int = 3) -> DataFrame:
    """df with `out`: x of each row, in sequence, where x = factor * (x of the row before) + offset, from 0 on, in each group.

    Steps of this kind compose to one of their kind (factors are multiplied, offsets carried on), in any grouping.  So spans of
    sequence numbers are folded where they lie, spans of those likewise, and what comes in from the left is added at the end.
    A row's number is its own in its group; a fold has the rows of a span, the highest one a row for each
    span ** (levels - 1) numbers.
    """
    kept = [c for c in df.columns if c not in (*by, seq)]
    rows = df.select(*by, F.col(seq).alias("_seq"), F.struct(*kept).alias("_row"), factor.cast("double").alias("_f"), offset.cast("double").alias("_o"))
    folded = _folded(rows.withColumn("_span", F.floor(F.col("_seq") / span)), [*by, "_span"])
    ends = folded.select(*by, "_span", F.element_at("_steps", -1).alias("_s")).select(*by, F.col("_span").alias("_seq"), F.struct().alias("_row"), "_s.f", "_s.o").withColumnsRenamed({"f": "_f", "o": "_o"})
    before = _before(ends, by, span, levels - 1)
    met = folded.join(before, [*by, "_span"], "left").select(*by, F.coalesce("_in", F.lit(0.0)).alias("_in"), F.explode("_steps").alias("_s"))
    return met.select(*by, F.col("_s.seq").alias(seq), *[F.col(f"_s.row.`{c}`").alias(c) for c in kept], (F.col("_s.f") * F.col("_in") + F.col("_s.o")).alias(out))


def _folded(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, _steps: for each row of (_seq, _row, _f, _o), in sequence, its number, its row, and the composition of all steps up to it."""
    steps = """aggregate(array_sort(collect_list(struct(_seq AS seq, _row AS row, _f AS f, _o AS o))), CAST(array() AS array<struct<seq: bigint, row: ROW, f: double, o: double>>),
        (a, s) -> concat(a, array(CASE WHEN size(a) = 0 THEN s ELSE named_struct('seq', s.seq, 'row', s.row, 'f', s.f * element_at(a, -1).f, 'o', s.f * element_at(a, -1).o + s.o) END)))"""
    return rows.withColumn("_seq", F.col("_seq").cast("bigint")).groupBy(*group).agg(F.expr(steps.replace("ROW", rows.schema["_row"].dataType.simpleString())).alias("_steps"))


def _before(ends: DataFrame, by: list[str], span: int, levels: int) -> DataFrame:
    """by, _span, _in: x before each span, from the spans' own steps (_seq is the span's number)."""
    if levels > 1:
        spans = ends.withColumn("_span", F.floor(F.col("_seq") / span))
        folded = _folded(spans, [*by, "_span"])
        upper = folded.select(*by, "_span", F.element_at("_steps", -1).alias("_s")).select(*by, F.col("_span").alias("_seq"), F.struct().alias("_row"), F.col("_s.f").alias("_f"), F.col("_s.o").alias("_o"))
        carried = _before(upper, by, span, levels - 1)
        folded = folded.join(carried, [*by, "_span"], "left").withColumn("_in", F.coalesce("_in", F.lit(0.0)))
    else:
        folded = _folded(ends, by).withColumn("_in", F.lit(0.0))
    each = folded.select(*by, "_in", F.posexplode("_steps").alias("_k", "_s"), "_steps")
    last = F.when(F.col("_k") == 0, F.col("_in")).otherwise(F.element_at("_steps", F.greatest("_k", F.lit(1)))["f"] * F.col("_in") + F.element_at("_steps", F.greatest("_k", F.lit(1)))["o"])
    return each.select(*by, F.col("_s.seq").alias("_span"), last.alias("_in"))


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df, ranged by `order`, with `out`: each row's number from 0.  df is written to the shared folder, so it should be narrow.

    Partitions are ranges; a row's number is its place in its partition and the rows of the partitions before it.
    Only those counts, one for each partition, come to the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    # the high bits of the id are the partition's number, the low ones the row's in it
    table = materialise(ranged.select("*", at.alias("_at"))).select("*", F.expr("_at DIV (1L << 33)").alias("_part"))
    sizes = sorted((r["_part"], r["count"]) for r in table.groupBy("_part").count().collect())
    before = [0, *accumulate(n for _, n in sizes)]
    bases = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part bigint, _base bigint")
    return table.join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_at") % F.lit(1 << 33) + F.col("_base")).alias(out))
