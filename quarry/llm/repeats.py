"""Repeats of W units (bytes or words) or more over all texts: what both substring operators share.

All suffixes are far too many to move.  Of each W consecutive grams' worth of text (a window) one gram is
picked by a local rule (the least hash, the leftmost of equals), so that equal windows, wherever they are,
pick the same gram at the same place; windows next to each other that pick the same gram form a cell.
A window that occurs twice has a gram that occurs twice, so:

1. chunks   texts are written, compressed, in chunks of about CHUNK bytes;
2. grams    each chunk sends its different picked grams, once each, and has two bits back for each: those that occur once
            anywhere end here;
3. cells    each chunk sends its different cells of repeated grams, once each, with their text and their first
            occurrence there; cells of a gram go to one group.  A gram with more than HOT occurrences has a
            longer prefix instead: its windows go one by one to groups by all their W units;
4. groups   equal windows are found in each group by the operator's own method (`refine`), and the first
            occurrence of each goes back to the chunks that need it;
5. marks    each chunk marks its windows that occur earlier.

A copy is sent once for each chunk, not once for each document, so that thousands of copies make no
hot group; nothing is dropped.  Hashes pick and group, where a collision costs time.  But cells of a gram (48 bits)
are known by 64 bits of hash, and words by 64 bits, without a look at their text: two different ones that collide would
count as equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.hashing import BYTE, batches, grams, grams16, least_in, numbered, range_hashes, spans_of, word_hashes
from quarry.llm.shared import NULL_ID, groups_for, materialise

CHUNK = 8 << 20
HOT = 50_000
#: Text, in bytes, of which a bucket has the grams or cells, at most.
BUCKET = 64 << 20
MOST_TASKS = 100_000
#: Units in a group's part that is refined at a time.
PART = 1 << 20


@dataclass(frozen=True)
class Plan:
    """window: W; gram: units in a gram; words: units are words, else bytes; within: an earlier start in the same document counts.

    refine(units, starts, ends, window) -> a number for each window of each cell, the same for equal windows.
    """

    window: int
    gram: int
    words: bool
    within: bool
    refine: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass
class Units:
    """Some documents' units: values, where each unit is in buf, and each document's units."""

    buf: np.ndarray
    values: np.ndarray
    first: np.ndarray
    last: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def units_of(plan: Plan, texts: list[bytes]) -> Units:
    sizes = np.array([len(t) for t in texts], np.int64)
    if not plan.words:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        at = np.zeros(0, np.int64)
        return Units(buf, BYTE[buf], at, at, ends - sizes, ends)
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    first, last = spans_of((buf != 32) & ((buf < 9) | (buf > 13)))
    ends = np.searchsorted(first, np.cumsum(sizes + 1))
    return Units(buf, word_hashes(buf, first, last), first, last, np.concatenate(([0], ends[:-1])), ends)


def _grams(plan: Plan, values: np.ndarray) -> np.ndarray:
    return grams16(values) if plan.gram == 16 else grams(values, plan.gram)


def cells_of(plan: Plan, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, where the gram is and the gram (48 bits) of each cell."""
    w = plan.window
    none = np.zeros(0, np.int64)
    g = _grams(plan, u.values)
    low = least_in((g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64), w - plan.gram + 1)
    if not len(low):
        return none, none, none, none.astype(np.uint64)
    long = u.ends - u.starts >= w
    edge = np.zeros(len(u.values) + 1, np.int8)
    np.add.at(edge, u.starts[long], 1)
    np.add.at(edge, u.ends[long] - w + 1, -1)
    p = np.flatnonzero(np.cumsum(edge, dtype=np.int8))
    if not len(p):
        return none, none, none, none.astype(np.uint64)
    pick = (low[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(pick)) + 1
    first = np.concatenate(([0], cut))
    return p[first], p[np.concatenate((cut - 1, [len(p) - 1]))], pick[first], g[pick[first]] >> np.uint64(16)


def _hash_of_cells(plan: Plan, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A hash of each cell values[start:end] and its gram: what cells of a gram are known by."""
    return range_hashes(values, starts, ends) ^ g


def keys_of(plan: Plan, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram and hash of each cell values[start:end], from its text alone and where in it the gram is."""
    picked = values[((starts + at)[:, None] + np.arange(plan.gram)).ravel()]
    g = _grams(plan, picked)[:: plan.gram] >> np.uint64(16)
    return g, _hash_of_cells(plan, values, starts, ends, g)


def _zip(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays, each with its length before it, compressed; numbers byte by byte of equal weight, which compresses better."""
    parts = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()
        parts += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unzip(blob: bytes, *types: str | None) -> list:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little")
        part = raw[at + 8 : at + 8 + n]
        at += 8 + n
        if t is None:
            out.append(part)
        else:
            size = np.dtype(t).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(size, -1).T).reshape(-1).view(t))
    return out


def chunks(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, docs: the ids (a null one as NULL_ID), sizes and texts of some documents."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            blob = _zip(np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64), b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + n], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "docs"])

        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                ids.append(NULL_ID if i is None else i)
                texts.append(t or b"")
                size += len(t or b"") + 16
                if size >= chunk:
                    yield full()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield full()

    return docs.select("doc_id", "text").mapInArrow(work, "chunk bigint, docs binary")


def read_chunk(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    ids, sizes, data = _unzip(blob, "<i8", "<i8", None)
    ends = np.cumsum(sizes)
    return ids, [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _picked(plan: Plan, texts: list[bytes]) -> Iterator[tuple[int, int, Units, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    for a, b in batches(texts):
        u = units_of(plan, texts[a:b])
        yield a, b, u, cells_of(plan, u)


def _sent_grams(grams: list[np.ndarray], n_buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """A chunk's different grams in order, how often it has each, and which of them it sends to each bucket."""
    every, counts = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint64), return_counts=True)
    return every, counts, list(_by_bucket((every % np.uint64(n_buckets)).astype(np.int64)))


def _rows(names: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(names, columns, strict=True)})


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    # numbers of 16 bits are sorted by their digits
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65_536 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


_SENT = [("bucket", pa.int64()), ("chunk", pa.int64()), ("sent", pa.binary())]
_BACK = [("chunk", pa.int64()), ("kind", pa.int32()), ("back", pa.binary())]


def _send_grams(plan: Plan, n_buckets: int):
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every, counts, sent = _sent_grams([g for _, _, _, (_, _, _, g) in _picked(plan, read_chunk(blob)[1])], n_buckets)
                rows = [(b, chunk, _zip(every[at], np.minimum(counts[at], 2**31).astype("<u4"))) for b, at in sent]
                yield from _rows(_SENT, rows).to_batches()

    return work


def _repeated_grams(hot: int):
    """Back to each chunk, for each gram in the order that it sent them: is it repeated, is it hot; a bit each, as the chunk knows its grams."""

    def work(key, t):
        keys, counts, chunk = [], [], []
        ids = t["chunk"].to_pylist()
        for k, blob in enumerate(t["sent"].to_pylist()):
            a, c = _unzip(blob, "<u8", "<u4")
            keys.append(a)
            counts.append(c)
            chunk.append(np.full(len(a), k, np.int32))
        keys, counts, chunk = np.concatenate(keys), np.concatenate(counts), np.concatenate(chunk)
        order = np.argsort(keys, kind="stable")
        keys, counts, chunk = keys[order], counts[order].astype(np.int64), chunk[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts, np.flatnonzero(first))[np.cumsum(first) - 1]
        rows = []
        for k, at in _by_bucket(chunk.astype(np.int64)):  # the order is stable: a chunk's grams are in theirs
            again = total[at] > 1
            if again.any():
                rows.append((ids[k], 0, _zip(np.array([key[1].as_py(), len(at)], "<i8"), np.packbits(again), np.packbits(total[at] > hot))))
        return _rows(_BACK, rows)

    return work


def _cells(plan: Plan, texts: list[bytes], back: list[bytes], n_buckets: int):
    """For each run of texts: (first text, after the last, units, first and last window of each cell of a repeated gram, where the gram is, the gram, is it hot, the cell's hash)."""
    # units of words are kept, as they are more work and few; those of bytes are eight times their text
    picked = [(a, b, u if plan.words else None, cells) for a, b, u, cells in _picked(plan, texts)]
    every, _, sent = _sent_grams([g for _, _, _, (_, _, _, g) in picked], n_buckets)
    again, hot = np.zeros(len(every), bool), np.zeros(len(every), bool)
    sent = dict(sent)
    for blob in back:
        (bucket, n), *bits = _unzip(blob, "<i8", "u1", "u1")
        again[sent[int(bucket)]], hot[sent[int(bucket)]] = (np.unpackbits(x, count=int(n)).astype(bool) for x in bits)
    for a, b, u, (s, e, p, g) in picked:
        u = u or units_of(plan, texts[a:b])
        at = np.searchsorted(every, g)
        has = again[at]
        s, e, p, g, h = s[has], e[has], p[has], g[has], hot[at[has]]
        if h.any():  # each window of its own
            n = e[h] - s[h] + 1
            each = np.repeat(s[h], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, e, p, g, h = (np.concatenate((x[~h], y)) for x, y in ((s, each), (e, each), (p, np.repeat(p[h], n)), (g, np.repeat(g[h], n)), (h, np.ones(len(each), bool))))
        yield a, b, u, s, e, p, g, h, _hash_of_cells(plan, u.values, s, e + plan.window, g)


def _doc_of(u: Units, s: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
    """The text that each window is in, and where in it the window starts, in units."""
    k = np.searchsorted(u.ends, s, side="right")
    return a + k, s - u.starts[k]


def _send_cells(plan: Plan, n_buckets: int):
    def work(key, chunk, back):
        if not chunk.num_rows or not back.num_rows:
            return _rows(_SENT, [])
        ids, texts = read_chunk(chunk["docs"][0].as_py())
        cols: list[list] = [[] for _ in range(8)]
        pieces: list[bytes] = []
        for a, b, u, s, e, p, g, h, x in _cells(plan, texts, back["back"].to_pylist(), n_buckets):
            doc, start = _doc_of(u, s, a)
            # within these texts, a cell once, with its first occurrence
            order = np.lexsort((start, ids[doc], x))
            first = np.concatenate(([True], x[order][1:] != x[order][:-1])) if len(order) else np.zeros(0, bool)
            many = np.diff(np.concatenate((np.flatnonzero(first), [len(order)]))) > 1
            one = order[first]
            lo, hi = (u.first[s[one]], u.last[e[one] + plan.window - 1]) if plan.words else (s[one], e[one] + plan.window)
            raw = u.buf.tobytes()
            pieces += [raw[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
            for c, v in zip(cols, (x[one], g[one], ids[doc[one]], start[one], e[one] - s[one] + 1, many, h[one], p[one] - s[one]), strict=True):
                c.append(v)
        if not pieces:
            return _rows(_SENT, [])
        x, g, doc, start, n, many, h, p = map(np.concatenate, cols)
        order = np.lexsort((start, doc, x))
        first = np.concatenate(([True], x[order][1:] != x[order][:-1]))
        many = np.logical_or.reduceat(many[order] | ~first, np.flatnonzero(first))
        one = order[first]
        text_order = np.lexsort((start[one], doc[one]))  # documents and starts in order take less room
        one, many = one[text_order], many[text_order]
        x, g, doc, start, n, h, p = x[one], g[one], doc[one], start[one], n[one], h[one], p[one]
        pieces = [pieces[i] for i in one.tolist()]
        bucket = (np.where(h, x, g) % np.uint64(n_buckets)).astype(np.int64)
        rows = []
        for b, at in _by_bucket(bucket):
            text = [pieces[i] for i in at.tolist()]
            sizes = np.array([len(p) for p in text], "<u4")
            # grams and hashes, which nothing compresses, are made again of the text
            rows.append((b, chunk["chunk"][0].as_py(), _zip(p[at].astype("<u4"), doc[at], start[at], n[at].astype("<u4"), many[at].astype("u1"), sizes, b"".join(text))))
        return _rows(_SENT, rows)

    return work


def _refined(plan: Plan):
    """First occurrences of the windows of each cell, back to the chunks that need them."""
    w = plan.window

    def units_in(pieces):
        if not plan.words:
            return np.frombuffer(b"".join(pieces), np.uint8)
        buf = np.frombuffer(b"\n".join(pieces), np.uint8)
        lo, hi = spans_of((buf != 32) & ((buf < 9) | (buf > 13)))
        return word_hashes(buf, lo, hi)

    def runs_of(sizes, most):
        """Runs [first, after the last) of cells of about `most` bytes together, a cell at least."""
        total = np.cumsum(sizes, dtype=np.int64)
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most)))
            yield a, b
            a = b

    def runs(doc, start, n, units, starts, ends):
        """For cells: (cell, first window, after the last, document, start) of runs of windows with first occurrences alike."""
        group = plan.refine(units, starts, ends, w)
        cell = np.repeat(np.arange(len(n)), n)
        r = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        d, s = doc[cell], start[cell] + r
        number, count = numbered(group.astype(np.uint64))
        bd, bs = d.copy(), s.copy()
        twice = np.flatnonzero(count[number] > 1)  # a window alone is its own first occurrence
        if len(twice):
            order = twice[np.lexsort((s[twice], d[twice], number[twice]))]
            first = np.concatenate(([True], number[order][1:] != number[order][:-1]))
            best = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            bd[order], bs[order] = d[best], s[best]
        new = np.concatenate(([True], (cell[1:] != cell[:-1]) | (bd[1:] != bd[:-1]) | (bs[1:] - bs[:-1] != 1)))
        at = np.flatnonzero(new)
        stop = np.concatenate((at[1:], [len(cell)]))
        return cell[at], r[at], r[at] + (stop - at), bd[at], bs[at]

    def work(key, t):
        chunk_ids = t["chunk"].to_pylist()
        got = [_unzip(x, "<u4", "<i8", "<i8", "<u4", "u1", "<u4", None) for x in t["sent"].to_pylist()]
        p, doc, start, n, many, sizes = (np.concatenate([y[k] for y in got]) for k in range(6))
        data = b"".join(y[6] for y in got)
        chunk = np.repeat(np.arange(len(got)), [len(y[0]) for y in got])
        del got
        text_end = np.cumsum(sizes.astype(np.int64))
        g, x = np.empty(len(n), np.uint64), np.empty(len(n), np.uint64)
        for a, b in runs_of(sizes, PART):
            units = units_in([data[i - k : i] for i, k in zip(text_end[a:b].tolist(), sizes[a:b].tolist(), strict=True)])
            ends = np.cumsum(n[a:b].astype(np.int64) + w - 1)
            g[a:b], x[a:b] = keys_of(plan, BYTE[units] if not plan.words else units, ends - n[a:b] - w + 1, ends, p[a:b].astype(np.int64))
        order = np.lexsort((start, doc, x, g))
        x, g, doc, start, n, many, chunk, at = x[order], g[order], doc[order], start[order], n[order].astype(np.int64), many[order].astype(bool), chunk[order], order
        first = np.concatenate(([True], (x[1:] != x[:-1]) | (g[1:] != g[:-1])))
        one = np.flatnonzero(first)  # each different cell, with its first occurrence
        mine = np.cumsum(first) - 1  # of each cell sent, which of these
        cuts = [0]
        length = n[one] + w - 1
        new_gram = np.concatenate(([True], g[one][1:] != g[one][:-1]))
        total = np.cumsum(length)
        for k in np.flatnonzero(new_gram)[1:].tolist():  # parts of whole grams
            if total[k - 1] - (total[cuts[-1] - 1] if cuts[-1] else 0) >= PART:
                cuts.append(k)
        cuts.append(len(one))
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            some = one[a:b]
            units = units_in([data[int(text_end[i] - sizes[i]) : int(text_end[i])] for i in at[some].tolist()])
            ends = np.cumsum(n[some] + w - 1)
            for c, v in zip(found, runs(doc[some], start[some], n[some], units, ends - n[some] - w + 1, ends), strict=True):
                c.append(v)
            found[0][-1] = found[0][-1] + a
        cell, lo, hi, bd, bs = map(np.concatenate, found)
        run_at = np.searchsorted(cell, np.arange(len(one) + 1))
        # which of the cells sent have a window with an earlier occurrence, or are there more than once
        other = (bd != doc[one][cell]) | (bs != start[one][cell] + lo)
        changed = np.zeros(len(one), bool)
        changed[cell[other]] = True
        need = changed[mine] | many | ~first
        rows = []
        for k, sent in _by_bucket(chunk[need].astype(np.int64)):
            cells = mine[need][sent]
            count = run_at[cells + 1] - run_at[cells]
            pick = np.repeat(run_at[cells], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows.append((chunk_ids[k], 1, _zip(x[one][cells], count.astype("<u4"), lo[pick].astype("<u4"), hi[pick].astype("<u4"), bd[pick], bs[pick])))
        return _rows(_BACK, rows)

    return work


def _joined(plan: Plan, u: Units, at: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[tuple]:
    """(document here, start, end, source's id, start there) of maximal runs of windows that go on in step in one document here and one source.

    at: where in u each given run of n windows begins; doc, start: where its first window's source is.
    """
    order = np.argsort(at, kind="stable")
    at, n, doc, start = at[order], n[order], doc[order], start[order]
    here = np.searchsorted(u.ends, at, side="right")
    goes_on = (here[1:] == here[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] - start[:-1] == at[1:] - at[:-1]) & (at[1:] == (at + n)[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    begin = at[first] - u.starts[here[first]]
    end = (at + n)[last] - u.starts[here[last]] + plan.window - 1
    return list(zip(here[first].tolist(), begin.tolist(), end.tolist(), doc[first].tolist(), start[first].tolist(), strict=True))


def marks(plan: Plan, n_buckets: int, chunk_blob: bytes, back: list[tuple[int, bytes]], matches: bool = False) -> Iterator[tuple[int, Units, np.ndarray | list[tuple], int, np.ndarray]]:
    """For runs of texts: (first text, units, which units are covered or else the matches with earlier texts, after the last text, ids)."""
    ids, texts = read_chunk(chunk_blob)
    got = [_unzip(b, "<u8", "<u4", "<u4", "<u4", "<i8", "<i8") for kind, b in back if kind == 1]
    if got:
        x, count, lo, hi, bd, bs = (np.concatenate([y[k] for y in got]) for k in range(6))
        run_end = np.cumsum(count.astype(np.int64))
        order = np.argsort(x, kind="stable")
        x, run_at, count = x[order], (run_end - count)[order], count[order].astype(np.int64)
    for a, b, u, s, e, _, _, _, h in _cells(plan, texts, [b for kind, b in back if kind == 0], n_buckets):
        covered, found = np.zeros(len(u.values), bool), []
        if got and len(s):
            at = np.minimum(np.searchsorted(x, h), len(x) - 1)
            has = x[at] == h
            s, at = s[has], at[has]
            n = count[at]
            pick = np.repeat(run_at[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = np.repeat(s, n)
            doc, start = _doc_of(u, s, a)
            first = lo[pick].astype(np.int64)
            earlier = bd[pick] < ids[doc]
            if plan.within:
                earlier |= (bd[pick] == ids[doc]) & (bs[pick] < start + first)
            if matches and earlier.any():
                found = _joined(plan, u, (s + first)[earlier], (hi[pick].astype(np.int64) - first)[earlier], bd[pick][earlier], bs[pick][earlier])
            edge = np.zeros(len(u.values) + 1, np.int64)
            np.add.at(edge, (s + first)[earlier], 1)
            np.add.at(edge, (s + hi[pick].astype(np.int64) + plan.window - 1)[earlier], -1)
            covered = np.cumsum(edge[:-1]) > 0
        yield a, u, found if matches else covered, b, ids


#: What is left of a document, and the runs of its units that are removed.
KEPT = [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def spans_in(covered: np.ndarray) -> list[dict[str, int]]:
    """Start and end of each run of covered units."""
    cuts = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
    return [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2], strict=True)]


def n_removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed")


def _tasks(sent: DataFrame, n_buckets: int):
    """sent by bucket, each bucket a task of its own (or, beyond MOST_TASKS, some dealt out evenly), not as many as a hash happens to bring together."""
    n = min(n_buckets, MOST_TASKS)
    return sent.withColumn("part", F.expr(f"CAST(bucket % {n} AS INT)")).repartitionById(n, F.col("part")).groupBy("part", "bucket")


def find(docs: DataFrame, plan: Plan, finish: Callable, schema: str, names: list[tuple[str, pa.DataType]], chunk: int = CHUNK, hot: int = HOT, matches: bool = False) -> DataFrame:
    """finish(units, covered or matches, ids of these texts) -> rows, for each run of texts."""
    table = materialise(chunks(docs, chunk), "chunk")  # the texts are not shuffled: what comes back to them is
    n_chunks = table.count()
    # a chunk sends a row to each bucket: buckets grow with the root of the corpus, so that rows don't become too small, but
    # not beyond what fits in memory
    each = min(BUCKET, max(chunk, int(chunk * math.sqrt(n_chunks / 64))))
    n_buckets = groups_for(n_chunks * chunk, each, 16)
    grams_back = materialise(_tasks(table.mapInArrow(_send_grams(plan, n_buckets), "bucket bigint, chunk bigint, sent binary"), n_buckets).applyInArrow(_repeated_grams(hot), "chunk bigint, kind int, back binary"))
    by_chunk = table.groupBy("chunk")
    sent = by_chunk.cogroup(grams_back.groupBy("chunk")).applyInArrow(_send_cells(plan, n_buckets), "bucket bigint, chunk bigint, sent binary")
    cells_back = materialise(_tasks(sent, n_buckets).applyInArrow(_refined(plan), "chunk bigint, kind int, back binary"))

    def last(key, chunk, back):
        rows: list[tuple] = []
        if chunk.num_rows:
            for a, u, covered, b, ids in marks(plan, n_buckets, chunk["docs"][0].as_py(), list(zip(back["kind"].to_pylist(), back["back"].to_pylist(), strict=True)), matches):
                rows += finish(u, covered, ids[a:b])
        return _rows(names, rows)

    return by_chunk.cogroup(grams_back.union(cells_back).groupBy("chunk")).applyInArrow(last, schema)
