"""What a task holds at a time doesn't grow with its batches."""

import numpy as np
import pyarrow as pa

from quarry.operators import bpe, embedding


def test_runs_of_texts():
    sizes = pa.array([3, 0, None, 5, 2, 9, 1])
    assert list(bpe._runs(sizes, 4)) == [(0, 4), (4, 6), (6, 7)] and list(bpe._runs(sizes[:0], 4)) == []


def test_tokenizer_gets_runs(spark, monkeypatch):
    """Texts are encoded and decoded a run at a time, whatever the batch: here inside this process."""
    import public_tokenizers

    path, most = public_tokenizers.path("byte_bpe_50k.json"), []
    real = bpe._tokenizer(path)

    class Watched:
        def __getattr__(self, name):
            return getattr(real, name)

        def encode_batch_fast(self, texts, **options):
            most.append(sum(map(len, texts)))
            return real.encode_batch_fast(texts, **options)

    monkeypatch.setattr(bpe, "_tokenizer", lambda path: Watched())
    monkeypatch.setattr(bpe, "RUN", 100)
    monkeypatch.setattr(bpe.F, "arrow_udf", lambda kind: lambda f: lambda column: f)
    texts = pa.array(["some words " * k for k in range(9)] * 5)
    ids = bpe.encode(bpe.F.lit(""), path, "<|endoftext|>")(texts)
    assert max(most) < 200 and len(most) > 9
    assert bpe.decode(None, path)(ids).to_pylist() == texts.to_pylist()


def test_documents_that_ask_come_as_a_stream():
    """A block's vectors meet batch after batch of documents, and each gives its sums before the next is read."""
    schema = pa.schema([("block", pa.int64()), ("share", pa.int64()), ("asks", pa.int32()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    read = []

    def rows():
        yield pa.RecordBatch.from_pylist([{"block": 0, "share": 0, "asks": 0, "id": i, "vector": [float(i), 1.0]} for i in (2, 3)], schema)
        for k in range(5):
            read.append(k)
            yield pa.RecordBatch.from_pylist([{"block": 0, "share": 0, "asks": 1, "id": k, "ids": [2, 3, 4], "times": [1, 2, 9]}], schema)
        yield pa.RecordBatch.from_pylist([{"block": 1, "share": 0, "asks": 1, "id": 9, "ids": [2], "times": [1]}], schema)

    for k, b in enumerate(embedding._gathered(rows())):
        assert len(read) == k + 1
        assert b.to_pylist() == [{"seq": k, "n": 3, "total": np.array([8.0, 3.0]).tolist()}]
    assert k == 4
