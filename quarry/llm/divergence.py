"""How the sources of a language differ from it and from each other: an audit of word frequencies.

Each language keeps the terms that at least LEAST of its documents hold.  A group (language and source) gives each
kept term the smoothed probability p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)), and so does the language (q).

1. counts    each task counts terms by group, and sends a term's count when its table is full or the task ends;
             counts of a term are added before they are shuffled, so that a frequent term is no hot key.
2. terms     upper-bound search: a group's terms are in buckets by their count.  A bucket's greatest p less its least q
             bounds every difference in it.  Buckets are opened best first, some for each group at a time; a bucket whose
             bound is strictly below the group's kth best so far stays closed for good.
3. pairs     postings of a block of terms become a matrix with a column for each source, absent ones with the
             probability of a count of 0; each block gives one sum for each pair of sources, and blocks are added.

Defined results: null text, lang and source are ''.  Repeated rows and rows of one id are documents each.  A group
without kept terms has its pairs (of value 0 where its language keeps no term), and no terms.  A language of one source
has no pairs.  Texts of any length are read whole; a task holds one text's words and a table of TABLE terms.  Other
columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import discard, materialise

LEAST = 30
TOP = 50
SMOOTH = 5
SCALE = 1_000_000_000
#: Different (group, term) of a task before their counts are sent.
TABLE = 1 << 18
#: Terms of a group that the first round opens; each further round opens GROWTH times as many.
OPEN, GROWTH = 512, 16
#: Groups (about 100 bytes each) up to this number are broadcast to their terms.
BROADCAST = 1 << 16
#: Cells of a block's matrix: at least, at most.  Between, four for each pair of sources, so that sums are few beside cells.
CELLS, MOST_CELLS = 1 << 13, 1 << 22

#: Lower-cases A-Z; what is neither a letter nor non-ASCII becomes a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), d (documents), of each table of a task."""
    tables: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in tables.items():
            terms = list(n)
            for a in range(0, len(terms), 1 << 14):
                some = terms[a : a + (1 << 14)]
                same = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "d"])

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
            if not (words := terms_of(text)):
                continue
            n, d = tables.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            n.update(words)
            d.update(dict.fromkeys(words, 1))
            size += len(n)
            if size > TABLE:
                yield from sent()
                tables, size = {}, 0
    yield from sent()


def _probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (n + 5 * v)), exactly: in decimals, as the product may pass 64 bits."""
    top = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (n + v * SMOOTH).cast("decimal(20,0)")).cast("bigint") + 1


class Audit:
    """What both parts read.

    groups: lang, source, size (N), v (V), lang_size, width (sources of the language), blocks.
    terms: lang, source, term, n, p, q of each kept term that the group has.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST):
        rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
        sent = rows.mapInArrow(_count, "lang string, source string, term binary, n bigint, d bigint")
        counts = materialise(sent.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
        kept = materialise(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least).drop("d"))
        held = materialise(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_size"))
        sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("size", "v", "lang_size")])
        widths = groups.groupBy("lang").agg(F.count("*").alias("width"))
        cells = F.least(F.greatest(F.lit(CELLS).cast("bigint"), 4 * F.col("width") * F.col("width")), F.lit(MOST_CELLS))
        blocks = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("v") * F.col("width") / cells).cast("bigint"))
        self.groups = materialise(groups.join(widths, "lang").withColumn("blocks", blocks))
        side = self.groups.select("lang", "source", "size", "v", "lang_size", "blocks")
        side = F.broadcast(side) if self.groups.count() <= BROADCAST else side
        p, q = _probability(F.col("n"), F.col("size"), F.col("v")), _probability(F.col("lang_n"), F.col("lang_size"), F.col("v"))
        self.terms = materialise(held.join(side, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), F.pmod(F.xxhash64("term"), "blocks").alias("block")))
        discard(counts, kept, held)

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value: the sum over the language's terms of the differences of their probabilities."""
        zero = _probability(F.lit(0).cast("bigint"), F.col("size"), F.col("v"))
        columns = self.groups.select("lang", "source", F.when(F.col("v") > 0, zero).otherwise(0).alias("zero"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        postings = self.terms.select("lang", "block", "source", "term", "p")
        found = postings.groupBy("lang", "block").cogroup(columns.groupBy("lang", "block")).applyInArrow(_block_pairs, "lang string, a string, b string, value bigint")
        sums = materialise(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
        return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    def top_terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item (term), value, rank: the terms that a group has most beyond its language."""
        group = ["lang", "source"]
        order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
        # counts up to 16 have a bucket each, larger ones four for each doubling
        bucket = F.when(F.col("n") <= 16, F.col("n")).otherwise(F.floor(F.log2("n") * 4) + 16).cast("bigint")
        terms = self.terms.withColumn("bucket", bucket)
        closed = materialise(terms.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("n")).where("bound > 0"))
        best, budget = None, OPEN
        while True:
            promising = closed
            if best is not None:
                kth = best.groupBy(*group).agg(F.when(F.count("*") == top, F.min("value")).alias("kth"))
                promising = closed.join(kth, group, "left").where("kth IS NULL OR bound >= kth")
            before = F.sum("n").over(Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")) - F.col("n")
            opened = materialise(promising.withColumn("before", before).where(F.col("before") < budget).select(*group, "bucket"))
            if opened.isEmpty():
                discard(closed, opened)
                break
            side = F.broadcast(opened) if opened.count() <= BROADCAST else opened
            found = terms.join(side, [*group, "bucket"]).where("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            both = found if best is None else found.union(best.select(*found.columns))
            new = materialise(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
            rest = materialise(closed.join(side, [*group, "bucket"], "left_anti"))
            discard(*[t for t in (closed, opened, best) if t is not None])
            closed, best, budget = rest, new, budget * GROWTH
        return best if best is not None else self.terms.limit(0).select(*group, F.col("term").alias("item"), F.col("p").alias("value"), F.lit(0).alias("rank"))


def _block_pairs(key: tuple, postings: pa.Table, columns: pa.Table) -> pa.Table:
    """For each two sources, in order, the sum of the differences over the block's terms."""
    sources = sorted(columns["source"].to_pylist(), key=str.encode)
    place = {s: k for k, s in enumerate(sources)}
    zero = np.zeros(len(sources), np.int64)
    zero[[place[s] for s in columns["source"].to_pylist()]] = columns["zero"].to_numpy()
    rows = postings["term"].combine_chunks().dictionary_encode()
    matrix = np.tile(zero, (len(rows.dictionary), 1))
    at = postings["source"].combine_chunks().dictionary_encode()
    column = np.array([place[s] for s in at.dictionary.to_pylist()], np.int64)
    if len(rows):
        matrix[rows.indices.to_numpy(), column[at.indices.to_numpy()]] = postings["p"].to_numpy()
    first, second, values = [], [], []
    for k, s in enumerate(sources[:-1]):
        first += [s] * (len(sources) - k - 1)
        second += sources[k + 1 :]
        values.append(np.abs(matrix[:, k + 1 :] - matrix[:, k : k + 1]).sum(axis=0))
    lang = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
    return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "a": pa.array(first, pa.string()), "b": pa.array(second, pa.string()), "value": pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64())})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank (from 1 by group and part: value descending, item ascending)."""
    made = Audit(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = made.pairs().withColumn("rank", F.row_number().over(order))
    shape = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(shape).union(made.top_terms(top).withColumn("part", F.lit("term")).select(shape))
