"""Suffix-array dedup of exact substrings: bucket-pointer refinement of suffixes down to 50 bytes.

The suffixes of a group (repeats.py deals them out) are put into buckets by their first eight bytes.
Then buckets are refined by sorting on the bucket of a later offset: suffixes alike in 8 bytes by the
bucket 8 bytes on, giving 16, then 16 on, giving 32, and so to 50; each refinement's buckets are the
pointers of the next.  A suffix alone in its bucket is finished: it keeps its pointer, by which the others go
on being told apart, and isn't sorted again; nor is one that no window left together with another reaches.  Suffixes left together share 50 bytes; nothing is refined
beyond, so no order of whole suffixes results.

A byte is removed if a 50-byte string over it also starts in a document with a smaller id.

Defined results: null texts are empty.  Null ids count as the largest.  Rows with the same id aren't
each other's source.  Each row of documents gets one row; other columns aren't read.  A document of any length goes
whole into one chunk; what a task holds of it is about 60 bytes a byte for at most a megabyte of text or one document, and about two bytes a byte of its chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.hashing import numbered
from quarry.llm.repeats import KEPT, NULL_ID, Plan, Units, find, n_removed, spans_in

WINDOW = 50
Q = 8


def refine(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of each cell units[start:end], the same for equal windows: its suffix's bucket at the window's depth."""
    n = len(units)
    gram = np.zeros(max(0, n - Q + 1), np.uint64)
    for k in range(Q):
        gram = (gram << np.uint64(8)) | units[k : n - Q + 1 + k]
    bucket, count = numbered(gram)
    more = count[bucket] > 1
    bucket = bucket.astype(np.uint64)
    steps, depth = [], Q
    while depth < window:
        steps.append(min(depth, window - depth))
        depth += steps[-1]
    at, new = _windows(starts, ends, window), len(count)
    for k, step in enumerate(steps):
        left = at[more[at]]
        if not len(left):
            break
        # the windows not yet alone, and the suffixes that later steps reach from them: others' pointers aren't asked for
        need = np.zeros(len(bucket), bool)
        for reach in _sums(steps[k + 1 :]):
            need[left + reach] = True
        open_ = np.flatnonzero(need & more)
        number, count = numbered((bucket[open_] << np.uint64(32)) | bucket[open_ + step])
        bucket[open_] = (new + number).astype(np.uint64)
        more[open_] = count[number] > 1
        new += len(count)
    return bucket[at]


def _sums(steps: list[int]) -> set[int]:
    """The sums of any of the steps."""
    out = {0}
    for step in steps:
        out |= {step + x for x in out}
    return out


def _windows(starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Where each window of each cell starts."""
    n = ends - starts - window + 1
    return np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _finish(u: Units, covered: np.ndarray, ids: np.ndarray) -> list[tuple]:
    rows = []
    left = u.buf[~covered].tobytes()
    sums = np.concatenate(([0], np.cumsum(~covered)))
    for i, a, b in zip(ids.tolist(), u.starts.tolist(), u.ends.tolist(), strict=True):
        rows.append((None if i == NULL_ID else i, b - a, left[sums[a] : sums[b]], spans_in(covered[a:b]) if sums[b] - sums[a] < b - a else []))
    return rows


def kept(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """One row for each document: doc_id, n_bytes, kept (the bytes left; cuts may be within characters), spans (start and end of each run of bytes removed)."""
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), *KEPT]
    return find(docs, Plan(window, 16, False, False, refine), _finish, "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start: bigint, end: bigint>>", names, **sizes)


def dedup(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """One row for each document, from what is kept: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return kept(docs, window, **sizes).select("doc_id", "n_bytes", n_removed(), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
