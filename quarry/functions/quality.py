"""Word statistics and the ordered quality verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: ASCII words with inner apostrophes and hyphens.
WORD = "[a-z0-9]+(?:['’-][a-z0-9]+)*"

#: Verdicts in the order in which they are given.
VERDICTS = ("dup_raw", "dup_normalized", "empty", "short", "word_length", "symbol_ratio", "repetitive")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    min_mean: float = 2.0
    max_mean: float = 15.0
    min_word_char_ratio: float = 0.60
    max_repeat_ratio: float = 0.30


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def with_word_stats(df: DataFrame, text: str, limits: Limits = Limits()) -> DataFrame:
    """df with n_words, word_chars, n_chars, too_repetitive; no shuffle.

    A word fills more than the share r of n words if and only if, among sorted words, one equals the
    one floor(r * n) places on.
    """
    k = f"CAST(floor(size(s) * {round(limits.max_repeat_ratio * 1000)}L / 1000) AS INT)"
    repeat = f"size(s) > 0 AND exists(sequence(0, size(s) - 1), i -> i + {k} < size(s) AND s[i] = s[least(i + {k}, size(s) - 1)])"
    # the one-element array names the sorted words once
    stats = F.expr(f"transform(array(_words), s -> named_struct('n', size(s), 'chars', length(array_join(s, '')), 'repetitive', {repeat}))[0]")
    df = df.withColumn("_words", F.sort_array(words(F.coalesce(text, F.lit(""))))).withColumn("_stats", stats)
    return df.withColumns(
        {
            "n_words": F.col("_stats.n").cast("bigint"),
            "word_chars": F.col("_stats.chars").cast("bigint"),
            "n_chars": F.length(F.coalesce(text, F.lit(""))).cast("bigint"),
            "too_repetitive": F.col("_stats.repetitive"),
        }
    ).drop("_stats", "_words")


def verdict(limits: Limits = Limits()) -> Column:
    """The first rule that fails, over the columns of with_word_stats; null if none does."""
    mean = F.col("word_chars") / F.col("n_words")
    return (
        F.when((F.col("n_words") < limits.min_words) | (F.col("n_words") == 0), "short")
        .when((mean < limits.min_mean) | (mean > limits.max_mean), "word_length")
        .when(F.col("word_chars") / F.col("n_chars") < limits.min_word_char_ratio, "symbol_ratio")
        .when(F.col("too_repetitive"), "repetitive")
    )
