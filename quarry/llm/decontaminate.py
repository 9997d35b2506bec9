"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of ten consecutive words of every benchmark item (the whole item if it has fewer) go into one
automaton over normalised text, word by word (a step for each word, not for each letter); each document is normalised and scanned once, and what is found is
mapped back to words and to offsets of the original text.

The items are sent to every executor, which makes the automaton once for each Python worker, so what goes
into it is bounded: a benchmark of more than SHARD_BYTES of text is dealt by a hash of the items' ids into
shards of about that size, whose automaton takes about 100 bytes a byte of text (a test measures it).  Documents are then searched for one shard after the other, each a job of
its own, and what the shards found, by row, is put together.

Defined results: null texts have no words, and items without words have no window.  Items with the
same id count as one; an item with a null id marks words but isn't listed.  Each row of documents gets
one row, repeated or not.  Texts of any length are scanned whole.  Other columns aren't read (scan) or are
kept (clean).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import materialise
from quarry.llm.words import chars_at, folded_starts, folded_words

WINDOW = 10
SHARD_BYTES = 4 << 20


def windows_of(items: list[tuple[int | None, str | None]], n: int = WINDOW) -> tuple[dict[bytes, int], dict[tuple[int, ...], list]]:
    """A number from 1 for each word of the items; and each window, of such numbers, with the ids of the items that have it."""
    number: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list] = {}
    for item, text in items:
        words = [number.setdefault(w, len(number) + 1) for w in folded_words((text or "").encode())]
        for k in range(max(1, len(words) - n + 1) if words else 0):
            ids = found.setdefault(tuple(words[k : k + n]), [])
            if item not in ids:
                ids.append(item)
    return number, found


@dataclass(frozen=True)
class Made:
    """Words by number, and the automaton over windows of numbers (none: no windows)."""

    number: dict[bytes, int]
    automaton: ahocorasick.Automaton | None


def automaton(items: list[tuple[int | None, str | None]]) -> Made:
    number, windows = windows_of(items)
    if not windows:
        return Made(number, None)
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, ids in windows.items():
        a.add_word(w, (len(w), ids))
    a.make_automaton()
    return Made(number, a)


def hits(words: list[bytes], made: Made) -> tuple[list[list[int]], set]:
    """Runs of hit words [first, after the last], merged, and the items found."""
    runs: list[list[int]] = []
    items: set = set()
    if made.automaton is None or not words:
        return runs, items
    # 0: a word of no item
    line = tuple(map(made.number.get, words, itertools.repeat(0)))
    for start, end, ids in sorted(((end - n + 1, end + 1, ids) for end, (n, ids) in made.automaton.iter(line)), key=lambda x: x[:2]):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
        items.update(ids)
    return runs, items


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


#: A worker's automaton and what it was made from; kept from task to task.
_made: dict[bytes, Made] = {}


def _automaton_of(items: list[tuple[int | None, str | None]], key: bytes) -> Made:
    if key not in _made:
        _made.clear()
        _made[key] = automaton(items)
    return _made[key]


Items = list[tuple[int | None, str | None]]


def shards(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Items]:
    """The items of each shard; no more than one shard's come to the driver at a time."""
    items = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t"))
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // shard_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.toLocalIterator()]


def _finder(items: Items):
    """A function from texts to (words, runs, ids as strings, sorted) of each."""
    key = hashlib.sha256(repr(items).encode()).digest()

    def find(texts: pa.Array) -> Iterator[tuple[int, list[list[int]], list[str]]]:
        a = _automaton_of(items, key)
        for text in texts.cast(pa.large_binary()).to_pylist():
            words = folded_words(text or b"")
            runs, ids = hits(words, a)
            yield len(words), runs, sorted({str(i) for i in ids if i is not None})

    return find


_FOUND = "_key bigint, _runs array<bigint>, _items array<string>"


def _search(keyed: DataFrame, items: Items) -> DataFrame:
    """_key, _runs (flat list of first, after last), _items of the rows that have a window of a shard's items."""
    find = _finder(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, [x for r in runs for x in r], ids) for k, (_, runs, ids) in zip(b.column(0).to_pylist(), find(b.column(1)), strict=True) if runs]
            keys, runs, ids = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], names=["_key", "_runs", "_items"])

    return keyed.select("_key", "_text").mapInArrow(work, _FOUND)


def _by_shards(rows: DataFrame, first: Items, rest: Iterator[Items]) -> DataFrame:
    """rows (with _text) and _runs, _items, where the benchmark has several shards."""
    keyed = materialise(rows.withColumn("_key", F.monotonically_increasing_id()))
    found = materialise(_search(keyed, first))
    for items in rest:
        found = found.union(materialise(_search(keyed, items)))
    # a row of found for each shard at most
    found = found.groupBy("_key").agg(F.flatten(F.collect_list("_runs")).alias("_runs"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    return keyed.join(found, "_key", "left").drop("_key")


def _digest(i: int | None, text: bytes | None, n: int, runs: list[list[int]], items: list[str]) -> tuple:
    spans = ""
    if runs:
        at = folded_starts(text)
        chars = chars_at(text, [p for a, b in runs for p in (at[a][0], at[b - 1][1])])
        spans = ",".join(f"{a}:{b}" for a, b in zip(chars[::2], chars[1::2], strict=True))
    return i, n, sum(b - a for a, b in runs), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(runs), spans


def scan(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: the hit runs as start:end in code points of the original text, comma-joined.
    """
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.string()]
    rest = shards(benchmark, shard_bytes)
    first, second = next(rest), next(rest, None)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    if second is None:
        find = _finder(first)

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).cast(pa.large_binary())
                yield batch([_digest(i, t, *x) for i, t, x in zip(b.column(0).to_pylist(), texts.to_pylist(), find(texts), strict=True)])

        return rows.mapInArrow(once, schema)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, flat, items in zip(b.column("_id").to_pylist(), b.column("_text").cast(pa.large_binary()).to_pylist(), b.column("_runs").to_pylist(), b.column("_items").to_pylist(), strict=True):
                runs = _merged([flat[k : k + 2] for k in range(0, len(flat or ()), 2)])
                out.append(_digest(i, t, len(folded_words(t or b"")), runs, sorted(items or ())))
            yield batch(out)

    return _by_shards(rows, first, itertools.chain([second], rest)).mapInArrow(put_together, schema)


def clean(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns."""
    rest = shards(benchmark, shard_bytes)
    first, second = next(rest), next(rest, None)
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    if second is None:
        find = _finder(first)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clear = pa.array([not runs for _, runs, _ in find(b.column(1))], pa.bool_())
                yield b.select([0]).filter(clear)

        kept = rows.mapInArrow(work, T.StructType([rows.schema["_row"]]))
    else:
        kept = _by_shards(rows, first, itertools.chain([second], rest)).where("_runs IS NULL")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
