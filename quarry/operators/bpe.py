"""Byte-pair encoding of documents with any tokenizers file, and decoding."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bytes of text, or ids, that the tokenizer has at a time.
RUN = 1 << 19


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(path: str, eos: str) -> tuple[int, int]:
    """Size of the vocabulary, which must fit 16 bits, and the id of the end-of-document token, which must exist."""
    t = _tokenizer(path)
    if t.get_vocab_size() > 65_536:
        raise ValueError(f"{t.get_vocab_size()} ids don't fit 16 bits")
    if (id := t.token_to_id(eos)) is None:
        raise ValueError(f"no token {eos!r}")
    return t.get_vocab_size(), id


def encode(text: Column, path: str, eos: str) -> Column:
    """Ids of the text without special tokens, then the end-of-document id; a null text is an empty one."""
    _, end = vocabulary(path, eos)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        sizes, parts = np.zeros(len(texts) + 1, np.int64), []
        for a, z in _runs(pc.binary_length(texts), RUN):
            # what the tokenizer gives has places and pieces besides ids, many times the text: it lasts for one run
            some = [[*e.ids, end] for e in _tokenizer(path).encode_batch_fast(texts[a:z].to_pylist(), add_special_tokens=False)]
            sizes[a + 1 : z + 1] = [len(x) for x in some]
            parts.append(np.concatenate([np.array(x, np.int32) for x in some]))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        parts = [_tokenizer(path).decode_batch(ids[a:z].to_pylist(), skip_special_tokens=True) for a, z in _runs(pc.list_value_length(ids), RUN)]
        return pa.array([t for part in parts for t in part], pa.string())

    return texts(ids)


def _runs(sizes: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs [first, after the last) of rows of about `most` bytes or ids together; a longer row is a run of its own."""
    first = total = 0
    for i, n in enumerate(sizes.to_pylist()):
        total += n or 0
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def generated_context(ids: Column, context: int, new: Column) -> Column:
    """The last `context` ids and one more, as a sampler goes on."""
    return F.concat(F.when(F.size(ids) > context, F.slice(ids, -context, context)).otherwise(ids), F.array(new))
