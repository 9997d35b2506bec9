"""Language identification by mixtures: each document's languages and their shares.

A document is a mixture of languages, each of which gives n-grams (four bytes of lower-cased text, all that aren't letters
being a space) with the frequencies learned for it.

1. fit       n-grams of labelled documents are counted by language in BINS bins.  Of a language about SAMPLE documents
             are read, chosen by a digest of their ids, or all if it has no more.
2. mixture   a document starts with the language that explains it best.  The language whose share would raise the
             likelihood most steeply joins the set, and expectation-maximisation finds the set's shares; it stays
             if the likelihood, less PENALTY for each language and share, rises.  So on until none does.
3. answer    the language with the largest share, and that share.

n-grams overlap, so that a text has about a quarter as many independent ones; likelihoods are divided by that.

Defined results: null texts and those without a letter are 'und' with score 0.  A null doc_id isn't held out, nor is its
document learned from.  Without any labelled document all are 'und'.  More than MOST languages are an error, as each
takes 256 kB in every task.  Repeated rows are documents each.  Texts of any length are read whole, long ones in pieces whose counts are
added.  Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.hashing import batches, mix

GRAM = 4
BINS = 1 << 16
SAMPLE = 20_000
MOST = 1000
#: Added to each bin's count.
SMOOTH = 0.1
#: Log-likelihood that one more language must bring, beside half the logarithm of the number of n-grams.
PENALTY = 6.0
ROUNDS = 8
#: The share that a language joins with.
START = 0.1
#: Bytes that are counted at a time.
PIECE = 1 << 20

#: Letters of ASCII and bytes of other characters stay; the rest becomes a space.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def _line(text: str) -> bytes:
    """A single letter has an n-gram too."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b"  "


def grams_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each different n-gram of each line, in the order of the lines: line, bin, count."""
    buf = np.frombuffer(b"".join(lines) + bytes(GRAM), np.uint8)
    ends = np.cumsum([len(x) for x in lines])
    words = np.ndarray((int(ends[-1]),), np.uint32, buf.tobytes(), strides=(1,))
    # starts whose n-gram stays in its line; two spaces in a row say nothing
    inside = (buf[: len(words)] != 32) | (buf[1 : len(words) + 1] != 32)
    for k in range(1, GRAM):
        inside[np.maximum(ends - k, 0)] = False
    at = np.flatnonzero(inside)
    line = np.searchsorted(ends, at, side="right")
    bins = mix(words[at].astype(np.uint64)) & np.uint64(BINS - 1)
    packed, count = np.unique((line.astype(np.uint64) << np.uint64(16)) | bins, return_counts=True)
    return (packed >> np.uint64(16)).astype(np.int64), (packed & np.uint64(BINS - 1)).astype(np.int64), count


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """grams_of the texts; a long text alone is taken in pieces, each with the three bytes after it."""
    lines = [_line(t) for t in texts]
    if len(lines) != 1 or len(lines[0]) <= PIECE:
        return grams_of(lines)
    total = np.zeros(BINS, np.int64)
    for a in range(0, len(lines[0]), PIECE):
        _, bins, count = grams_of([lines[0][a : a + PIECE + GRAM - 1]])
        total[bins] += count
    some = np.flatnonzero(total)
    return np.zeros(len(some), np.int64), some, total[some]


class Model:
    """Languages, and the probability of each bin in each."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.stack([counts[x] for x in self.languages], axis=1).astype(np.float64) + SMOOTH if counts else np.zeros((BINS, 0))
        self.p = (table / table.sum(axis=0)).astype(np.float32)


def mixtures(model: Model, doc: np.ndarray, bins: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """The share of each language in each document (n_docs by languages); documents without n-grams have none."""
    shares = np.zeros((n_docs, len(model.languages)), np.float32)
    if not len(doc) or not len(model.languages):
        return shares
    p, count = model.p[bins], count.astype(np.float32)
    ids, first = np.unique(doc, return_index=True)
    total = np.add.reduceat(count, first)
    log = np.add.reduceat(count[:, None] * np.log(p), first)
    best = log.argmax(axis=1)
    rows = np.arange(len(ids))
    share = np.zeros((len(ids), p.shape[1]), np.float32)
    share[rows, best] = 1
    likelihood = log[rows, best]
    price = GRAM * (PENALTY + 0.5 * np.log(total / GRAM + 1))
    shares[ids] = share
    # the documents whose set may still grow, and their n-grams
    width = np.diff(np.append(first, len(doc)))
    for _ in range(len(model.languages) - 1):
        if not len(ids):
            break
        at = np.repeat(np.arange(len(ids)), width)
        first = np.cumsum(width) - width
        steep = np.add.reduceat((count / (p * share[at]).sum(axis=1))[:, None] * p, first)
        steep[share > 0] = -1
        joins = steep.argmax(axis=1)
        rows = np.arange(len(ids))
        trial = share * np.float32(1 - START)
        trial[rows, joins] = START
        for _ in range(ROUNDS):
            trial *= np.add.reduceat((count / (p * trial[at]).sum(axis=1))[:, None] * p, first) / total[:, None]
        now = np.add.reduceat(count * np.log((p * trial[at]).sum(axis=1)), first)
        grew = (now - likelihood > price) & (steep[rows, joins] > total)
        shares[ids[grew]] = trial[grew]
        more = np.repeat(grew, width)
        ids, width, share, likelihood, total, price = ids[grew], width[grew], trial[grew], now[grew], total[grew], price[grew]
        p, count = p[more], count[more]
    return shares


def remainder():
    """crc32 of the doc_id as text, modulo 4; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learned from the text and lang of labelled documents that aren't held out, about `sample` of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 2)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not sizes:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    place = {x: k for k, x in enumerate(sorted(sizes))}

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in batches(texts, PIECE):
                doc, bins, count = features(texts[a:z])
                of = np.array([place[x] for x in langs[a:z]])[doc]
                for k in np.unique(of).tolist():
                    mine = total.setdefault(k, np.zeros(BINS, np.int64))
                    np.add.at(mine, bins[of == k], count[of == k])
        for k, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["k", "bin", "n"])

    table = drawn.select("lang", "text").mapInArrow(work, "k int, bin int, n bigint").groupBy("k", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = {x: np.zeros(BINS, np.int64) for x in sizes}
    languages = sorted(sizes)
    k, bins, n = (table[c].to_numpy() for c in ("k", "bin", "n"))
    for j, x in enumerate(languages):
        counts[x][bins[k == j]] = n[k == j]
    return Model(counts)


def shares(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the document's languages with their shares, largest first (null: no letters)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = sent.value.languages
        # rows of n-grams by languages are bounded
        most = max(1 << 14, (4 * PIECE) // max(4, len(languages)))
        for b in it:
            texts = [t if t is not None and has_letter(t) else None for t in b.column(1).to_pylist()]
            out: list[list[dict] | None] = []
            for a, z in batches([t or "" for t in texts], most):
                found = mixtures(sent.value, *features([t or "" for t in texts[a:z]]), z - a)
                for t, row in zip(texts[a:z], found.astype(np.float64), strict=True):
                    order = np.argsort(-row, kind="stable")
                    out.append([{"lang": languages[k], "share": min(1.0, float(row[k]))} for k in order.tolist() if row[k] > 0] if t is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "languages"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, languages array<struct<lang: string, share: double>>")


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (as lang:share, largest first, comma-joined)."""
    found = shares(docs, fit(docs, sample))
    top = F.try_element_at("languages", F.lit(1))
    said = F.array_join(F.transform("languages", lambda x: F.concat(x["lang"], F.lit(":"), F.format_string("%.3f", x["share"]))), ",")
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.coalesce(top["lang"], F.lit("und")).alias("lang_pred"), F.coalesce(top["share"], F.lit(0.0)).alias("score"), F.coalesce(said, F.lit("")).alias("languages"))
