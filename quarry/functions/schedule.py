"""Training-schedule arithmetic and number formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_at(step: Column, total: int, lr: float, min_ratio: float = 0.1, warmup_frac: float = 0.05) -> Column:
    """Linear warm-up, then a cosine down to lr * min_ratio."""
    warmup = max(1, int(warmup_frac * total))
    floor = lr * min_ratio
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(max(1, total - warmup)))
    cosine = F.lit(floor) + F.lit(0.5 * (lr - floor)) * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, F.lit(lr) * (step + 1) / F.lit(warmup)).otherwise(cosine)


def eval_step(epoch: Column, i: Column, steps_per_epoch: int, evals: int) -> Column:
    """Steps of the evaluations, evenly spaced; halves round to even."""
    return (epoch * steps_per_epoch + F.bround(i * F.lit(float(steps_per_epoch)) / evals, 0)).cast("bigint")


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def finite_mean(x: Column) -> Column:
    """The mean of what is finite, as an aggregate."""
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x))


def short_number(n: Column) -> Column:
    """6.85M, 12.3K"""
    return F.when(n >= 1e6, F.concat(F.format_number(n / 1e6, 2), F.lit("M"))).otherwise(F.concat(F.format_number(n / 1e3, 1), F.lit("K")))


def axis_number(x: Column) -> Column:
    """0, 500K, 3M"""
    return F.when(x == 0, "0").when(x >= 1e6, F.concat(F.format_number(F.bround(x / 1e6, 0), 0), F.lit("M"))).otherwise(F.concat(F.format_number(F.bround(x / 1e3, 0), 0), F.lit("K")))


def lr_label(v: Column) -> Column:
    """5e-4"""
    said = F.format_string("%.0e", v)
    return F.concat(F.split_part(said, F.lit("e"), F.lit(1)), F.lit("e-"), F.abs(F.split_part(said, F.lit("e"), F.lit(2)).cast("int")).cast("string"))


def setting_label(key: Column, v: Column) -> Column:
    whole = v.cast("int").cast("string")
    return (
        F.when(key == "lr", F.concat(F.lit("lr "), lr_label(v)))
        .when(key == "batch_size", F.concat(F.lit("batch "), whole))
        .when(key == "n_layer", F.concat(whole, F.lit(" layer"), F.when(v != 1, "s").otherwise("")))
        .when(key == "n_embd", F.concat(F.lit("d = "), whole))
        .when(key == "seq_len", F.concat(F.lit("T = "), whole))
    )


def printable(text: Column) -> Column:
    """On one line, without replacement characters."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("�"), F.lit("")), r"(?U)[\s\x1C-\x1F]+", " "), r" \z", "")
