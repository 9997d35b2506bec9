"""Tokens of each document in flat token files without an index, by a separator scan.

Each block is searched for separators at once (numpy); it tells how many it has, where the last one
is and how many tokens stand between them.  A prefix scan over blocks, in two levels so that no file is one
task's work, says for each block how many documents ended before it and how many tokens of an open document
it takes over.

Defined results: an empty document counts 0 tokens.  Tokens after the last separator of a file are a document that
isn't complete.  Null ids of documents stay null; repeated rows are counted one by one.  A document of any length
may go on through any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import flat_tokens
from quarry.llm.shared import materialise

BLOCK = 1 << 16
#: Blocks that one step of the lower level scans.
SPAN = 1024


def separators(blocks: DataFrame, separator: int) -> DataFrame:
    """file, block, n, last (tokens up to and with its last separator, or null), gaps (tokens before each separator, since the one before or the block's start)."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            last, gaps = [], []
            for raw in b.column(3).to_pylist():
                at = np.flatnonzero(np.frombuffer(raw, "<u2") == separator)
                last.append(int(at[-1]) + 1 if len(at) else None)
                gaps.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(last, pa.int64()), pa.array(gaps, pa.list_(pa.int64()))], names=["file", "block", "n", "last", "gaps"])

    return blocks.select("file", "block", "n", "tokens").mapInArrow(work, "file bigint, block bigint, n bigint, last bigint, gaps array<bigint>")


def count(blocks: DataFrame, block: int, separator: int = flat_tokens.SEPARATOR, span: int = SPAN) -> DataFrame:
    """file, nth (from 0 in the file), n_tokens, complete, block, i: the i-th document to end in the block."""
    found = materialise(separators(blocks, separator).withColumn("span", F.expr(f"block DIV {span}")).withColumn("upto", F.col("block") * block + F.col("last")))
    before = lambda *by: Window.partitionBy(*by)
    spans = found.groupBy("file", "span").agg(F.max("upto").alias("upto"), F.sum(F.size("gaps")).alias("ended"))
    earlier = before("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("file", "span", F.max("upto").over(earlier).alias("upto0"), F.coalesce(F.sum("ended").over(earlier), F.lit(0)).alias("ended0"))
    within = before("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = found.join(spans, ["file", "span"]).select(
        "file",
        "block",
        "n",
        "gaps",
        "last",
        (F.col("block") * block - F.coalesce(F.greatest("upto0", F.max("upto").over(within)), F.lit(0))).alias("open"),
        (F.col("ended0") + F.coalesce(F.sum(F.size("gaps")).over(within), F.lit(0))).alias("ended"),
    )
    done = at.select("file", "block", "open", "ended", F.posexplode("gaps").alias("i", "gap"))
    done = done.select("file", (F.col("ended") + F.col("i")).alias("nth"), (F.col("gap") + F.when(F.col("i") == 0, F.col("open")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("complete"), "block", "i")
    # what follows the last separator of a file
    end = at.groupBy("file").agg(F.max_by(F.struct("n", "last", "open", "ended", F.size("gaps").alias("here"), "block"), "block").alias("e")).select("file", "e.*")
    rest = end.select("file", (F.col("ended") + F.col("here")).alias("nth"), F.when(F.col("last").isNull(), F.col("open") + F.col("n")).otherwise(F.col("n") - F.col("last")).alias("n_tokens"), F.lit(False).alias("complete"), "block", F.col("here").alias("i"))
    return done.union(rest.where("n_tokens > 0"))


def count_documents(docs: DataFrame, tokenizer: str, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """doc_id, nth (its place among all documents, in the stable order of flat_tokens.py), n_tokens of each document, counted in the flat files written from them."""
    separator = flat_tokens.separator_of(tokenizer)
    flat = materialise(flat_tokens.write(docs, tokenizer, block))
    bases = materialise(flat_tokens.bases(flat))  # a row for each split of the input
    names = flat.select("file", "block", F.posexplode("ends").alias("i", "doc_id"))
    counted = count(flat, block, separator, span).join(F.broadcast(bases), "file").select("file", "block", "i", (F.col("docs0") + F.col("nth")).alias("nth"), "n_tokens")
    return counted.join(names, ["file", "block", "i"], "left").select("doc_id", "nth", "n_tokens")
