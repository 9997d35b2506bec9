"""The cleaning plan: raw dedup, normalisation, normalised dedup, quality verdict, funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions.hashing import digest, key
from quarry.functions.normalize import normalize
from quarry.functions.quality import VERDICTS, Limits, verdict, with_word_stats
from quarry.operators.dedup import mark, survivors
from quarry.sources.storage import materialise


#: What is known of a record without its text.
FACTS = ["seq", "id", "source", "domain", "url", "title", "shard", "n_bytes", "clean_bytes", "n_words", "word_chars", "n_chars", "too_repetitive", "_raw_key", "_norm_key"]


def facts(raw: DataFrame, limits: Limits = Limits(), text: bool = False) -> DataFrame:
    """One pass over the texts of raw records (seq, id, source, text, n_bytes, ...): keys, statistics and lengths, and clean_text if asked for."""
    sha = F.col("sha256") if "sha256" in raw.columns else digest(F.col("text"))
    df = normalize(raw.withColumn("_raw_key", key(sha)).drop("n_chars"), "text", "clean_text")
    df = df.withColumn("_norm_key", F.when(F.col("clean_text") != "", key(digest(F.col("clean_text"))))).withColumn("clean_bytes", F.octet_length("clean_text").cast("bigint"))
    df = with_word_stats(df, "clean_text", limits)
    return df.select(*[c for c in FACTS if c in df.columns], *(["clean_text"] if text else []))


def judged(raw: DataFrame, limits: Limits = Limits(), text: bool = False) -> DataFrame:
    """Raw records (seq, id, source, text, n_bytes, ...) without their texts, with clean_bytes and verdict (null: kept); clean_text if asked for.

    Texts are scanned once, and only keys, statistics and lengths (with the clean text, if asked for) are written to the shared folder.
    Both dedups are bitmaps of sequence numbers, so that nothing is shuffled but keys and numbers.  In exchange what is a raw
    duplicate is normalised too.  A record counts as seen even if a later gate rejects it; an empty one isn't seen by
    the second dedup.
    """
    df = materialise(facts(raw, limits, text))
    df = mark(df, survivors(df, "_raw_key", "seq"), "seq", "_raw_first")
    # a raw duplicate has no key, so it can't be the first of a normalised text
    again = df.select("seq", F.when(F.col("_raw_first"), F.col("_norm_key")).alias("_norm_key"))
    df = mark(df, survivors(again, "_norm_key", "seq"), "seq", "_norm_first")
    what = F.when(F.col("_raw_key").isNotNull() & ~F.col("_raw_first"), "dup_raw").when(F.col("_norm_key").isNull(), "empty").when(~F.col("_norm_first"), "dup_normalized").otherwise(verdict(limits))
    return df.withColumn("verdict", what).drop("_raw_key", "_raw_first", "_norm_key", "_norm_first")


def funnel(judged: DataFrame) -> DataFrame:
    """verdict, ordinal, docs, bytes (of the input) removed; every verdict has a row."""
    spark = judged.sparkSession
    names = spark.createDataFrame([(k, v) for k, v in enumerate(VERDICTS)], "ordinal int, verdict string")
    sums = judged.where("verdict IS NOT NULL").groupBy("verdict").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"))
    return names.join(sums, "verdict", "left").select("verdict", "ordinal", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def kept(judged: DataFrame) -> DataFrame:
    """Clean documents, from records judged with their texts: seq, id, source, domain, url, title, n_bytes (of the clean text), text."""
    return judged.where("verdict IS NULL").select("seq", "id", "source", "domain", "url", "title", F.col("clean_bytes").alias("n_bytes"), F.col("clean_text").alias("text"))


def totals(judged: DataFrame) -> DataFrame:
    """Documents and bytes by verdict, by source and over all, in one pass: what, name, docs_in, docs_out, bytes_in, bytes_out."""
    out = F.when(F.col("verdict").isNull(), F.col("clean_bytes")).otherwise(0)
    df = judged.select(F.coalesce("verdict", F.lit("kept")).alias("verdict"), "source", "n_bytes", out.cast("bigint").alias("out"))
    sums = df.groupingSets([[F.col("verdict")], [F.col("source")], []], F.col("verdict"), F.col("source")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("docs_in"), F.sum(F.when(F.col("out") > 0, 1).otherwise(0)).alias("docs_out"), F.sum("n_bytes").alias("bytes_in"), F.sum("out").alias("bytes_out")
    )
    what = F.when(F.col("g") == 1, "verdict").when(F.col("g") == 2, "source").otherwise("total")
    return sums.select(what.alias("what"), F.coalesce("verdict", "source", F.lit("all")).alias("name"), "docs_in", "docs_out", "bytes_in", "bytes_out")


def observed(judged: DataFrame) -> tuple[DataFrame, Observation]:
    """judged, and what passes through it while an action runs: documents, bytes, kept."""
    seen = Observation("clean")
    return judged.observe(seen, F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"), F.count_if(F.col("verdict").isNull()).alias("kept")), seen
