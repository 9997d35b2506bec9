"""License scan by ordered signature rules.

Over two hundred regexes, written one by one (license_rules.py): sentences of license bodies and headers,
identifiers and full names, notices, mentions.  Each is gated by a keyword; one automaton finds the
keywords that a text has.  Every detection has the priority of its rule; one that lies within a
detection of the same or higher priority is suppressed.  Besides, four fixed phrases are counted
wherever their words stand one after the other; no rule suppresses those.

Defined results: null or empty texts have no words, no labels and score 0.  Any white space counts as one
space, so that a wrapped notice is found as a single line is.  Texts of any length are scanned whole.  One row for each row of
documents, also for repeated or null ids; other columns aren't read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.license_rules import KINDS
from quarry.llm.words import folded_words, spaced

#: Fixed values of the contract: phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@functools.cache
def rules() -> tuple[tuple[int, float, str, str, re.Pattern[bytes]], ...]:
    """Priority, confidence, label, keyword, regex; in the order of priority, then of the list."""
    return tuple((p, c, label, key, re.compile(regex.encode())) for p, c, some in KINDS for label, key, regex in some)


@functools.cache
def _gate() -> ahocorasick.Automaton:
    """Finds, in one pass over a text, which keywords it has."""
    a = ahocorasick.Automaton()
    for _, _, _, key, _ in rules():
        a.add_word(key, key)
    a.make_automaton()
    return a


def detections(text: bytes) -> list[tuple[int, int, int, float, str]]:
    """Start, end (in the lower-cased text with white space made single), priority, confidence, label of what stays after suppression."""
    low = b" ".join(text.lower().split())
    has = {key for _, key in _gate().iter(low.decode("latin-1"))}
    if not has:
        return []
    found = [(m.start(), m.end(), p, c, label) for p, c, label, key, regex in rules() if key in has for m in regex.finditer(low)]
    found.sort(key=lambda d: (d[2], d[0] - d[1], d[0]))
    kept: list[tuple[int, int, int, float, str]] = []  # by start
    longest = 0
    for d in found:
        k = bisect.bisect_right(kept, d[0], key=lambda x: x[0])
        near = itertools.takewhile(lambda x: x[0] >= d[1] - longest, (kept[j] for j in range(k - 1, -1, -1)))
        if not any(d[1] <= x[1] for x in near):
            kept.insert(k, d)
            longest = max(longest, d[1] - d[0])
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of every place of a fixed phrase."""
    line, out = spaced(words), []
    for phrase, label in PHRASES:
        p = f" {phrase} ".encode()
        at = line.find(p)
        n, done = 0, 0
        while at >= 0:
            n += line.count(b" ", done, at)
            done = at
            out.append((n, label))
            at = line.find(p, at + 1)
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = folded_words(text or b"")
                base, own = base_places(words), detections(text or b"")
                at = [n for n, _ in base]
                first = {label for _, label in base}
                score = max([d[3] for d in own] + [0.8] * bool(base), default=0.0)
                rows.append((i, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(first)), ",".join(sorted(first | {d[4] for d in own})), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)
