"""Near-duplicates: chosen-path Jaccard join over five-word shingles.

1. Each document becomes its set of shingles (lower-cased words; a document of one to four words has
   one, of all its words), known by a 128-bit fingerprint, and a MinHash sketch of SKETCH tokens.
   Documents with the same set are one representative with its number of copies.
2. Representatives are split by a sketch token that is sampled by run and path; a bucket of more than
   BUCKET is split again, by BRANCHES tokens, each a path of its own, DEPTH times at most.  A pair of similarity
   s goes on together along a path with probability s at each step; the runs are as many as the
   target recall of pairs of similarity 0.8 asks for at the greatest depth (runs_for).
3. Small buckets are compared by brute force on sketches, generously.  A pair belongs to the first bucket, in
   the order of runs and paths, in which both are; every representative carries its earlier buckets,
   so that this is known on the spot and no pair is listed or met twice.
4. The texts of those that have a likely partner go to its bucket, and there all sets are compared
   exactly: links are counted, never listed, and a spanning star is kept for the classes.  Buckets of more
   than BLOCK are compared in blocks, one pair of blocks a task.

Defined results: null and empty texts have no shingles, are alike to nothing and are each a class of
their own.  Repeated rows are copies of each other.  Null ids count as the largest; a class of none
but those has a null id.  Texts of any length are taken whole; a task holds the texts of one bin of
buckets or of one pair of blocks.  Other columns aren't read (classes) or are kept (distinct_documents).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.hashing import batches, grams, mix, spans_of, word_hashes
from quarry.llm.shared import NULL_ID, discard, materialise, small_side
from quarry.llm.words import _FOLD

WORDS = 5
SKETCH = 64
#: Of pairs of similarity 0.8; more similar ones are missed more rarely.
RECALL = 0.9999
DEPTH = 3
BRANCHES = 2
BUCKET = 256
BLOCK = 512
#: Of SKETCH tokens, so many equal ones make a pair likely: at similarity 0.8, five standard deviations below the mean.
ALIKE = 35
#: Similarity: NUM / DEN of the union.
NUM, DEN = 4, 5
#: Representatives with a likely partner (24 bytes each) up to this number are broadcast to find their texts.
BROADCAST = 1 << 20
#: A text with none of these has no word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"

_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, SKETCH, dtype=np.uint64) | np.uint64(1)


def together(s: float, depth: int = DEPTH) -> float:
    """The probability that a run brings a pair of similarity s together in a bucket at this depth."""
    p = 1.0
    for _ in range(depth - 1):
        p = 1 - (1 - s * p) ** BRANCHES
    return s * p


def runs_for(recall: float, s: float = NUM / DEN) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(together(s, d) for d in range(1, DEPTH + 1)))))


#: Places of a run's buckets: BRANCHES at each depth below the first.
PATHS = BRANCHES ** (DEPTH - 1)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The different shingles of each text, ascending."""
    for first, last in batches(texts):
        some = texts[first:last]
        buf = np.frombuffer(b" ".join(some).translate(_FOLD), np.uint8)
        starts, ends = spans_of(buf != 32)
        words = word_hashes(buf, starts, ends)
        every = grams(words, WORDS)
        stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in some]))
        a = 0
        for b in stops.tolist():
            if b - a >= WORDS:
                yield np.unique(every[a : b - WORDS + 1])
            elif b > a:
                yield grams(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
            a = b


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits, the same for equal sets."""
    return mix(shingles).sum(dtype=np.uint64).tobytes() + mix(shingles + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).tobytes()


def sketch(shingles: np.ndarray) -> bytes:
    out = np.empty(SKETCH, np.uint32)
    for k in range(0, len(shingles), 1 << 14):
        part = shingles[k : k + (1 << 14)]
        least = np.array([(part * s >> np.uint64(32)).min() for s in _SEEDS]).astype(np.uint32)
        out = np.minimum(out, least) if k else least
    return out.tobytes()


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, h (digest of the text), fp, n (shingles), sketch of each row."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps, ns, sketches = [], [], []
            for s in shingle_sets([t or b"" for t in b.column(2).cast(pa.large_binary()).to_pylist()]):
                fps.append(fingerprint(s))
                ns.append(len(s))
                sketches.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "h", "fp", "n", "sketch"])

    return docs.select("doc_id", F.md5("text").alias("h"), "text").mapInArrow(work, "doc_id bigint, h string, fp binary, n bigint, sketch binary")


def _step(path: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Each path, one sketch token longer."""
    token = (path % np.uint64(SKETCH)).astype(np.int64)
    return mix(path * np.uint64(31) + (token.astype(np.uint64) << np.uint64(32)) + sketches[np.arange(len(sketches)), token])


def _array(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint32).reshape(-1, SKETCH)


_PLACED = "fp binary, slot int, path bigint"


def _roots(reps: DataFrame, runs: int) -> DataFrame:
    """fp, slot, path: the first step of each run."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = _array(b.column(1))
            for run in range(runs):
                path = _step(np.full(len(s), mix(np.array([run + 1], np.uint64))[0]), s)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(s), run * PATHS, np.int32)), pa.array(path.view(np.int64))], names=["fp", "slot", "path"])

    return reps.select("fp", "sketch").mapInArrow(work, _PLACED)


def _branches(placed: DataFrame, depth: int) -> DataFrame:
    """fp, slot, path of each branch of the paths placed (with their sketches), now `depth` steps long."""
    width = PATHS // BRANCHES ** (depth - 1)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s, slot, path = _array(b.column(3)), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            for branch in range(BRANCHES):
                longer = _step(mix(path + np.uint64(branch + 1)), s)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((slot + branch * width).astype(np.int32)), pa.array(longer.view(np.int64))], names=["fp", "slot", "path"])

    return placed.select("fp", "slot", "path", "sketch").mapInArrow(work, _PLACED)


def _leaves(reps: DataFrame, runs: int) -> tuple[DataFrame, list[DataFrame]]:
    """fp, slot, leaf, n: the buckets of two or more representatives that are compared by brute force; and the tables it reads."""
    out, tables = [], []
    rows = _roots(reps, runs)
    for depth in range(1, DEPTH + 1):
        rows = materialise(rows)
        # a table of its own, so that the join has two plain shuffles and Spark can split a bucket's rows
        sized = materialise(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        kept = materialise(rows.join(sized, "path"))
        discard(rows, sized)
        tables.append(kept)
        large = kept.where(F.col("n") > BUCKET)
        last = depth == DEPTH or large.isEmpty()
        out.append((kept if last else kept.where(F.col("n") <= BUCKET)).select("fp", "slot", F.xxhash64(F.lit(depth), "slot", "path").alias("leaf"), "n"))
        if last:
            break
        rows = _branches(large.join(reps.select("fp", "sketch"), "fp"), depth + 1)
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole, tables


def _in_blocks(df: DataFrame, group: str, n_bins: int) -> DataFrame:
    """df (with group, n, fp) with task, i, j, side: small groups together in bins, a large one once for each pair of its blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks"))
    df = df.withColumn("_blocks", blocks).withColumn("_own", own)
    other = F.explode(F.expr("sequence(0L, _blocks - 1)"))
    df = df.withColumn("_other", other).withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
    task = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64(group), F.lit(n_bins))).otherwise(F.xxhash64(group, "i", "j"))
    return df.withColumn("task", task).withColumn("side", F.col("_own") == F.col("i")).drop("_own", "_other", "_blocks")


def _stars(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the first vertex of each vertex's component."""
    n = len(linked)
    root = np.full(n, -1)
    for v in range(n):
        if root[v] < 0:
            root[v] = v
            front = np.array([v])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = v
    return root


class _Task:
    """A task's rows by bucket and pair of blocks."""

    def __init__(self, t: pa.Table):
        self.rows = t = t.sort_by([(c, "ascending") for c in ("leaf", "i", "j", "fp")]).combine_chunks()
        at = np.column_stack([t[c].to_numpy() for c in ("leaf", "i", "j")])
        cuts = (np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()
        self.groups = list(zip([0, *cuts], [*cuts, len(at)], strict=True)) if len(at) else []
        self.crossed = at[:, 1] != at[:, 2]
        self.side = t["side"].to_numpy(zero_copy_only=False)
        self.size = t["size"].to_numpy()
        before = t["before"].combine_chunks() if len(at) else pa.array([], t["before"].type)
        flat = before.flatten()
        slots = flat.field("slot").to_numpy()
        self.met = np.zeros((len(at), int(slots.max(initial=-1)) + 1), np.int64)
        self.met[np.repeat(np.arange(len(at)), np.diff(before.offsets.to_numpy())), slots] = flat.field("leaf").to_numpy()

    def open(self, a: int, b: int) -> np.ndarray:
        """Which pairs of rows a to b may be alike by size and belong to this bucket."""
        size = self.size[a:b]
        out = DEN * size[:, None] >= NUM * size[None, :]
        out &= out.T
        for k in range(self.met.shape[1]):
            m = self.met[a:b, k]
            if m.any():
                out &= (m[:, None] != m[None, :]) | (m[:, None] == 0)
        if self.crossed[a]:
            out &= self.side[a:b, None] != self.side[None, a:b]
        np.fill_diagonal(out, False)
        return out


_BEFORE = pa.list_(pa.struct([("slot", pa.int32()), ("leaf", pa.int64())]))
_LIKELY = "task bigint, leaf bigint, i bigint, j bigint, side boolean, fp binary, size bigint, before array<struct<slot: int, leaf: bigint>>"


def _alike(key, t):
    """Of each bucket or pair of blocks, the rows that have a likely partner there."""
    task = _Task(t)
    s = _array(task.rows["sketch"])
    found = []
    for a, b in task.groups:
        open_ = task.open(a, b)
        if not open_.any():
            continue
        same = np.zeros((b - a, b - a), np.uint8)
        for k in range(SKETCH):
            same += s[a:b, k, None] == s[None, a:b, k]
        found.append(a + np.flatnonzero(((same >= ALIKE) & open_).any(axis=1)))
    out = task.rows.take(pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
    return out.select(["task", "leaf", "i", "j", "side", "fp", "size"]).append_column("before", out["before"].cast(_BEFORE))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    m = len(sets)
    if m <= 4:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = counts[at] > 1
    column = np.cumsum(counts > 1) - 1
    rows, cols = rows[shared], column[at[shared]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((m, m), np.float64)
    width = max(256, (1 << 22) // m)
    for c in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, [c, c + width])
        block = np.zeros((m, width), np.float32)
        block[rows[a:b], cols[a:b] - c] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def _exact(key, t):
    """fp, links (to copies of other sets), root (of its star) of the sets with links in each bucket or pair of blocks."""
    task = _Task(t)
    fp, copies = task.rows["fp"].to_pylist(), task.rows["copies"].to_numpy()
    sets = list(shingle_sets([x or b"" for x in task.rows["text"].cast(pa.large_binary()).to_pylist()]))
    fps, links, roots = [], [], []
    for a, b in task.groups:
        both = common(sets[a:b])
        size = task.size[a:b]
        linked = ((NUM + DEN) * both >= NUM * (size[:, None] + size[None, :])) & task.open(a, b)
        for v, n, r in zip(range(a, b), (linked @ copies[a:b]).tolist(), _stars(linked).tolist(), strict=True):
            if n:
                fps.append(fp[v])
                links.append(n)
                roots.append(fp[a + r])
    return pa.table({"fp": pa.array(fps, pa.binary()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.binary())})


def _classes(docs: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, n of each row; fp, first, h, copies, class, links of each set with shingles)."""
    sets = materialise(_sets(docs))
    some = sets.where("n > 0").withColumn("k", F.coalesce("doc_id", F.lit(NULL_ID)))
    reps = some.groupBy("fp").agg(F.min(F.struct("k", "h")).alias("who"), F.count("*").alias("copies"), F.first("n").alias("size"), F.first("sketch").alias("sketch"))
    reps = materialise(reps.select("fp", F.col("who.k").alias("first"), "who.h", "copies", "size", "sketch"))
    n_bins = max(16, reps.count() // 1000)
    leaves, tables = _leaves(reps, runs_for(recall))
    # a representative's buckets, BRANCHES ** (DEPTH - 1) for each run at most
    own = leaves.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("slot", "leaf", "n"))).alias("all")).join(reps.select("fp", "size", "sketch"), "fp")
    placed = own.select("fp", "size", "sketch", "all", F.explode("all").alias("x"))
    before = F.expr("transform(filter(all, y -> y.slot < x.slot), y -> struct(y.slot, y.leaf))")
    placed = placed.select("fp", "size", "sketch", "x.leaf", "x.n", before.alias("before"))
    likely = materialise(_in_blocks(placed, "leaf", n_bins).drop("n").groupBy("task").applyInArrow(_alike, _LIKELY))
    discard(*tables)
    wanted = materialise(likely.select("fp").distinct().join(reps.select("fp", "first", "h", "copies"), "fp"))
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("first"), F.md5("text").alias("h"), "text")
    if wanted.count() <= BROADCAST:  # else all texts are shuffled to meet them
        texts = texts.join(F.broadcast(wanted.select("first", "h")), ["first", "h"], "left_semi")
    # repeated rows of the same id and text count once
    texts = texts.join(wanted, ["first", "h"]).groupBy("fp").agg(F.first("copies").alias("copies"), F.first("text").alias("text"))
    found = materialise(likely.join(texts, "fp").groupBy("task").applyInArrow(_exact, "fp binary, links bigint, root binary"))
    discard(likely, wanted)
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    labels = components(found.where("fp <> root").select(F.col("root").alias("a"), F.col("fp").alias("b")))
    each = reps.select("fp", "first", "h", "copies").join(links, "fp", "left").join(labels.select(F.col("v").alias("fp"), "label"), "fp", "left")
    return sets.select("doc_id", "fp", "n"), each.select("fp", "first", "h", "copies", F.coalesce("label", "fp").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id (the least id of its class), n_links (other documents of similarity 0.8 or more)."""
    rows, each = _classes(docs, recall)
    firsts = each.groupBy("class").agg(F.min("first").alias("class_id"))
    each = each.join(firsts, "class").select("fp", F.nullif("class_id", F.lit(NULL_ID)).alias("class_id"), (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    return rows.join(each, "fp", "left").select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def distinct_documents(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents, with all their columns, but of each class the one with the least id only."""
    _, each = _classes(docs, recall)
    # of a class, the row of the least id; where several texts have it, one of them
    keep = materialise(each.groupBy("class").agg(F.min(F.struct("first", "h")).alias("who")).select(F.col("who.first").alias("_k"), F.col("who.h").alias("_h"), F.lit(True).alias("_keep")))
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("_k"), F.md5("text").alias("_h"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_has"))
    kept = rows.join(small_side(keep, 100), ["_k", "_h"], "left").where("_keep OR NOT _has")
    # repeated rows: one stays; documents without words all stay
    alone = F.when(~F.col("_has"), F.monotonically_increasing_id())
    kept = kept.withColumn("_alone", alone).withColumn("_nth", F.row_number().over(Window.partitionBy("_k", "_h", "_alone").orderBy(F.xxhash64("_row")))).where("_nth = 1")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
