"""Token-id output in training order: every sequence has a slot by a keyed Feistel permutation.

Documents become flat token files (flat_tokens.py), whose stream is cut into sequences of STRIDE tokens,
numbered from 0 to N - 1 in the stream's order: the same numbers however the input is partitioned.  A balanced Feistel network permutes the numbers under the least even power of 2
that holds N; a number that comes out at N or more is permuted again until it doesn't (cycle-walking), so
that the slots are a permutation of 0 to N - 1 that anyone with the key can compute and invert, without
a table.  Slots are range-partitioned into shards of SHARD sequences of the same number of bytes: slot s is at byte
(s mod SHARD) * 2 * STRIDE of shard s div SHARD, so reading on from any slot is a seek.

Defined results: null texts are empty; the last sequence is filled up with separators.  Repeated rows and
null ids are documents like others; a text of any length goes on through as many sequences as it takes.  No
documents give no sequences.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import flat_tokens
from quarry.llm.hashing import mix
from quarry.llm.shared import materialise

STRIDE = 2048
SHARD = 1024
ROUNDS = 6
#: Tokens of a block of a flat file.
BLOCK = 1 << 16
#: Range partitions; beyond so many shards, several go to one.
MOST_PARTITIONS = 100_000


def _keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        left, right = right, left ^ (mix(right ^ k) & mask)
    return (right << np.uint64(half)) | left  # halves swapped back, so that the keys in reverse undo it


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of the numbers x, all below n; or with inverse, numbers of slots."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    keys = _keys(key)[::-1] if inverse else _keys(key)
    out = _network(x.astype(np.uint64), half, keys)
    while (far := out >= n).any():
        out[far] = _network(out[far], half, keys)
    return out


def materialise_order(docs: DataFrame, tokenizer: str, key: int = 20260918, stride: int = STRIDE, shard: int = SHARD, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """slot, shard, byte_offset, number (of the sequence), n_tokens (without filling), tokens_crc32, doc_ids (of documents that start in it), tokens.

    Partitions are runs of shards, in the order of slots.  With a folder (a URI or a path), the tasks that give the rows also
    write its files shard-NNNNNNNN.bin.  A file is complete or absent: it is written under another name first, and
    a task that runs again writes the same bytes.
    """
    flat = materialise(flat_tokens.write(docs, tokenizer, block))
    separator = flat_tokens.separator_of(tokenizer)
    bases = materialise(flat_tokens.bases(flat))  # a row for each split of the input
    n_tokens = flat.agg(F.sum("n").alias("n")).first()["n"] or 0
    total = -(-n_tokens // stride)
    n_shards = max(1, -(-total // shard))
    rows = flat.join(F.broadcast(bases), "file").select((F.col("tokens0") + F.col("block") * block).alias("from"), "tokens", "starts", "at")

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block cut where sequences end; pieces compressed, which the shuffle's own way does less well."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in it:
            for start, tokens, docs, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(tokens) // 2
                number = np.arange(start // stride, (start + n - 1) // stride + 1)
                edges = np.concatenate(([start], number[1:] * stride, [start + n])) - start
                slot = permute(number.astype(np.uint64), total, key).astype(np.int64)
                whose = np.searchsorted(at, edges)
                parts = [squeeze(tokens[2 * x : 2 * y]) for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                ids = [docs[x:y] for x, y in zip(whose.tolist(), whose.tolist()[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(number), pa.array((start + edges[:-1]) % stride), pa.array(ids, pa.list_(pa.int64())), pa.array(parts, pa.binary())], names=["slot", "number", "place", "doc_ids", "tokens"])

    pieces = rows.mapInArrow(place, "slot bigint, number bigint, place bigint, doc_ids array<bigint>, tokens binary")
    # slots are 0 to total - 1, so the bounds of the ranges are known and nothing needs to be sampled; a partition is a whole shard or more
    n = min(n_shards, MOST_PARTITIONS)
    dealt = pieces.repartitionById(n, F.expr(f"CAST((slot DIV {shard}) * {n} DIV {n_shards} AS INT)")).sortWithinPartitions("slot", "place")
    fill = separator.to_bytes(2, "little")

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a sequence, which follow each other, as one row; the rows of a shard to its file."""
        write = _Shards(folder) if folder else None
        unpack = zstandard.ZstdDecompressor().decompress

        def rows_of(some: list[tuple]) -> pa.RecordBatch:
            slot, number, doc_ids, tokens = zip(*some, strict=True)
            n = [len(t) // 2 for t in tokens]
            full = [t + fill * (stride - k) for t, k in zip(tokens, n, strict=True)]
            if write:
                for k, of in itertools.groupby(zip(slot, full, strict=True), key=lambda x: x[0] // shard):
                    write(k, b"".join(t for _, t in of))
            slot = np.array(slot)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // shard), pa.array(slot % shard * 2 * stride), pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(t) for t in full], pa.int64()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(full, pa.binary())], names=_NAMES
            )

        open_: list[tuple] = []
        for b in it:
            for slot, number, _, ids, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = unpack(piece)
                if open_ and open_[-1][0] == slot:
                    open_[-1] = (slot, number, open_[-1][2] + ids, open_[-1][3] + tokens)
                else:
                    open_.append((slot, number, ids, tokens))
            if len(open_) > 1:
                yield rows_of(open_[:-1])
                open_ = open_[-1:]
        if open_:
            yield rows_of(open_)
        if write:
            write.close()

    return dealt.mapInArrow(whole, "slot bigint, shard bigint, byte_offset bigint, number bigint, n_tokens bigint, tokens_crc32 bigint, doc_ids array<bigint>, tokens binary")


_NAMES = ["slot", "shard", "byte_offset", "number", "n_tokens", "tokens_crc32", "doc_ids", "tokens"]


class _Shards:
    """Writes shard files to a folder, one open at a time."""

    def __init__(self, folder: str):
        self.fs, self.top = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.top)
        self.now, self.at, self.part, self.file = None, "", "", None

    def __call__(self, shard: int, content: bytes) -> None:
        if shard != self.now:
            self.close()
            self.now, self.at = shard, f"{self.top}/shard-{shard:08d}.bin"
            self.part = f"{self.at}.{uuid.uuid4().hex}.part"
            self.file = self.fs.open_output_stream(self.part)
        self.file.write(content)

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.fs.move(self.part, self.at)
            self.file = None


def read_from(folder: str, slot: int, stride: int = STRIDE, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The sequences from a slot on, read one after the other."""
    fs, top = pyarrow.fs.FileSystem.from_uri(folder)
    k, at = divmod(slot, shard)
    while fs.get_file_info(path := f"{top}/shard-{k:08d}.bin").type == pyarrow.fs.FileType.File:
        with fs.open_input_file(path) as f:
            f.seek(at * 2 * stride)
            while raw := f.read(2 * stride):
                yield np.frombuffer(raw, "<u2")
        k, at = k + 1, 0
