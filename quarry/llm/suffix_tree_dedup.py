"""Substring dedup by windows of 20 words, refined word by word as the top of a suffix tree is.

Suffixes are dealt into memory-sized groups (repeats.py): those that begin with the same 20 words always
meet, by a gram sampled in those words, or by all 20 where that gram is very frequent.  In each group windows are
numbered top down, one word deeper at a time, while in a node with others; a window alone is a leaf
and isn't followed.  Nodes 20 words deep are the windows that occur more than once; nothing is grown beyond.
A longer repeat is a run of such windows whose first occurrences follow each other as well: maximal() gives
those, which no group sees as a whole, from the runs that come back to the texts.

A word is removed if a window of 20 words over it also starts earlier: in a document with a smaller
id, or before it in the same one.

Defined results: null texts have no words.  Null ids count as the largest; rows with the same id count as the
same document, and of windows at the same place in such rows none is earlier.  Each row of documents
gets one row; other columns aren't read.  A document of any length goes whole into one chunk; what a task holds of it
is about 60 bytes a byte for at most a megabyte of text or one document, and 24 bytes a word of its chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.repeats import KEPT, NULL_ID, Plan, Units, find, n_removed, spans_in

WINDOW = 20


def grow(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of each cell units[start:end], the same for equal windows: the tree's node or leaf."""
    word = np.unique(units, return_inverse=True)[1].astype(np.uint64)
    n = ends - starts - window + 1
    at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    node = np.zeros(len(at), np.uint64)
    leaves = 1 << 40  # leaves are numbered from here
    out = leaves + np.arange(len(at))
    open_ = np.arange(len(at))
    for depth in range(window):
        edge = (node << np.uint64(32)) | word[at[open_] + depth]
        _, node, count = np.unique(edge, return_inverse=True, return_counts=True)
        more = count[node] > 1
        open_, node = open_[more], node[more].astype(np.uint64)
    out[open_] = node.astype(np.int64)
    return out


def _finish(u: Units, covered: np.ndarray, ids: np.ndarray) -> list[tuple]:
    # bytes of kept words, each with the one after it, which becomes a space
    edge = np.zeros(len(u.buf) + 2, np.int8)
    stay = ~covered
    edge[u.first[stay]] += 1
    edge[u.last[stay] + 1] -= 1
    mask = np.cumsum(edge[: len(u.buf) + 1], dtype=np.int8) > 0
    text = np.append(u.buf, np.uint8(32))
    text[(text == 32) | ((text >= 9) & (text <= 13))] = 32
    left = text[mask].tobytes()
    sums = np.concatenate(([0], np.cumsum((u.last - u.first + 1) * stay)))
    rows = []
    for i, a, b in zip(ids.tolist(), u.starts.tolist(), u.ends.tolist(), strict=True):
        rows.append((None if i == NULL_ID else i, b - a, left[sums[a] : max(sums[a], sums[b] - 1)], spans_in(covered[a:b])))
    return rows


def kept(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """One row for each document: doc_id, n_words, kept (the words left, a space between them), spans (start and end of each run of words removed, in words)."""
    names = [("doc_id", pa.int64()), ("n_words", pa.int64()), *KEPT]
    found = find(docs, Plan(window, 6, True, True, grow), _finish, "doc_id bigint, n_words bigint, kept binary, spans array<struct<start: bigint, end: bigint>>", names, **sizes)
    return found.withColumn("kept", F.col("kept").cast("string"))


def dedup(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """One row for each document, from what is kept: doc_id, n_words, n_removed, kept_sha256."""
    return kept(docs, window, **sizes).select("doc_id", "n_words", n_removed(), F.sha2("kept", 256).alias("kept_sha256"))


def maximal(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """Repeats as long as they are: doc_id, start, end (in words), source_id, source_start.

    A repeat is a run of words, `window` or more, all of whose windows occur first, one after the other, in one document;
    it can't be made longer at either end.  Null ids of either side are null.
    """

    def rows_of(u: Units, found: list[tuple], ids: np.ndarray) -> list[tuple]:
        said = lambda i: None if i == NULL_ID else int(i)
        return [(said(ids[here]), a, b, said(doc), start) for here, a, b, doc, start in found]

    names = [(n, pa.int64()) for n in ("doc_id", "start", "end", "source_id", "source_start")]
    return find(docs, Plan(window, 6, True, True, grow), rows_of, ", ".join(f"{n} bigint" for n, _ in names), names, matches=True, **sizes)
