"""Ranked lexical search: every query item against every document, by sort-based accumulation.

Documents are read twice.  The first time each task counts, for the items' terms, the documents that hold them,
and all documents and terms.  From these each term's weight follows, and each document's length
norm.  The second time a task takes its documents in blocks:

1. a document's terms that items ask for give impacts; each is repeated for the items with the term, and the
   item, document and impact arrays of a block are concatenated;
2. they are radix sorted by item and document (documents come in order, so one pass over the items' 16-bit numbers
   is left), and the impacts of each (item, document) are added by reduceat;
3. of each item, what beats its kth best so far goes into a heap of k.

So (item, document) sums never leave their task: a task sends k rows for each item at most.  Those are dealt out by ranges of
items, and ranked.

Items are sent to all tasks, so what is sent is bounded: a shard has at most SHARD_TERMS (item, term) pairs, or one item, and
65,536 items.  Larger sets of items are searched for shard by shard, each against all documents.

Defined results: null texts have no terms; items without terms have no rows.  Each row of items is an item of its
own, also where ids are equal or null.  Documents with a null id come after all others of their score; each row is a document of
its own.  Texts of any length are read whole, one at a time.  Other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, IntegerType, LongType

from quarry.llm.shared import NULL_ID, materialise
from quarry.llm.words import folded_words

TOP = 10
SHARD_TERMS = 1 << 20
SHARD_ITEMS = 1 << 16
#: Entries of a block's arrays (about 40 bytes each) before they are sorted.
BLOCK = 1 << 20


class Shard:
    """Some items: their ids, the terms that they ask for, and by term the items that have it, with how often."""

    def __init__(self, first: int, ids: list, terms: list[Counter]):
        self.first, self.ids = first, ids
        self.number: dict[bytes, int] = {}
        pairs = [(self.number.setdefault(t, len(self.number)), k, n) for k, c in enumerate(terms) for t, n in c.items()]
        pairs.sort()
        term, item, times = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.item, self.times = item.astype(np.uint16), times
        self.start = np.searchsorted(term, np.arange(len(self.number) + 1))


def shards(items: DataFrame, shard_terms: int = SHARD_TERMS, shard_items: int = SHARD_ITEMS) -> Iterator[Shard]:
    """The items in shards; no more than one comes to the driver at a time."""
    ids, terms, size, done = [], [], 0, 0
    for r in items.select(F.col("item_id").alias("i"), F.col("text").alias("t")).toLocalIterator():
        count = Counter(folded_words((r["t"] or "").encode()))
        if ids and (size + len(count) > shard_terms or len(ids) == shard_items):
            yield Shard(done, ids, terms)
            done += len(ids)
            ids, terms, size = [], [], 0
        ids.append(r["i"])
        terms.append(count)
        size += len(count)
    if ids:
        yield Shard(done, ids, terms)


def _statistics(docs: DataFrame, shard: Shard) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and for each term of the shard the documents that hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(shard)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        held = np.zeros(len(number), np.int64)
        n_docs = n_terms = 0
        for b in batches:
            for text in b.column(0).cast(pa.large_binary()).to_pylist():
                words = folded_words(text or b"")
                n_docs += bool(words)
                n_terms += len(words)
                known = number.keys() & set(words)
                held[[number[t] for t in known]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], some))), pa.array(np.concatenate(([n_docs, n_terms], held[some])))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}  # a row for each of the shard's terms, at most
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(k, 0) for k in range(len(shard.number))], np.int64)


def weights(n: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)


class _Best:
    """Of each item the k best (score, then least document), by heaps; least: the scores that a newcomer must reach."""

    def __init__(self, k: int, n_items: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def take(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        may = score >= self.least[item]
        for i, s, d in zip(item[may].tolist(), score[may].tolist(), doc[may].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i, heap in enumerate(self.heaps):
            yield from ((i, s, -d) for s, d in heap)


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, document and summed impact of each pair; documents ascend."""
    order = np.argsort(item, kind="stable")  # of 16-bit numbers: a radix sort
    item, doc, impact = item[order], doc[order], impact[order]
    packed = (item.astype(np.int64) << 32) | doc
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    return item[first], doc[first], np.add.reduceat(impact, first)


def _search(docs: DataFrame, shard: Shard, top: int, id_type: pa.DataType, schema: StructType) -> DataFrame:
    """_item, item_id, doc_id (a null one as NULL_ID), score: the best of each task."""
    n, total, held = _statistics(docs, shard)
    sent = docs.sparkSession.sparkContext.broadcast((shard, weights(n, held)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, weight = sent.value
        number, width = mine.number, np.diff(mine.start)
        best = _Best(top, len(mine.ids))
        ids, terms, counts, sizes, norms, waiting = [], [], [], [], [], 0

        def block() -> None:
            term, tf = np.array(terms, np.int64), np.array(counts, np.int64)
            doc = np.repeat(np.arange(len(ids)), sizes)
            m = np.array(norms, np.int64)[doc]
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            each = width[term]
            at = np.repeat(mine.start[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            item, doc, score = accumulated(mine.item[at], np.repeat(doc, each), np.repeat(impact, each) * mine.times[at])
            best.take(item, score, np.array(ids, np.int64)[doc])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = Counter(folded_words(text or b""))
                known = number.keys() & words.keys()
                if not known:
                    continue
                some = [number[t] for t in known]
                ids.append(i)
                terms += some
                counts += [words[t] for t in known]
                sizes.append(len(some))
                norms.append(100 - 75 + 75 * words.total() * n // total)
                waiting += int(width[some].sum())
                if waiting >= BLOCK:
                    block()
                    ids, terms, counts, sizes, norms, waiting = [], [], [], [], [], 0
        if ids:
            block()
        rows = list(best.rows())
        item, score, doc = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([mine.first + i for i in item], pa.int64()), pa.array([mine.ids[i] for i in item], id_type), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["_item", "item_id", "doc_id", "score"])

    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(work, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, **sizes: int) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's best documents of a score above 0, equal scores by ascending doc_id."""
    kind = items.schema["item_id"]
    schema = StructType([StructField("_item", LongType()), StructField("item_id", kind.dataType), StructField("doc_id", LongType()), StructField("score", LongType())])
    found = None
    for shard in shards(items, **sizes):
        part = materialise(_search(docs, shard, top, to_arrow_type(kind.dataType), schema))
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), "doc_id")).cast(IntegerType())
    ranked = found.repartitionByRange(n, "_item").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score")
