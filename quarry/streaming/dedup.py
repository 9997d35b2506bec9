"""Streaming variants: first-wins dedup of arriving records, with state without end or bounded, resumed where it stopped."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from quarry.functions.hashing import digest, key

#: Bits of a filter for each key that it is made for, and bits that a key sets: about 1 in 2,000 keys is taken for a known one.
BITS, HASHES = 16, 11
#: Rows that are looked up at once.
CHUNK = 4096
#: What a session must have for bounded state.  Batches without data would follow each other without end: what has outlived its time goes with the next data.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def arriving(spark: SparkSession, path: str, schema: str, files_a_time: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_time).parquet(path)


def dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """The first arrival of each text.  State holds a 64-bit key for each text seen, without end, as the batch plan's contract asks."""
    return stream.withColumn("raw_key", key(digest(F.col(text)))).dropDuplicates(["raw_key"])


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    """A row of HASHES places in a filter of `size` bits for each key, by double hashing."""
    a, b = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


class Filter:
    """A Bloom filter over 64-bit keys as plain bytes; none are an empty filter."""

    def __init__(self, capacity: int, content: bytes | None):
        size = -(-capacity * BITS // 8)
        self.bytes = np.frombuffer(content, np.uint8).copy() if content else np.zeros(size, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = _bits(keys, 8 * len(self.bytes))
        return ((self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def add(self, keys: np.ndarray) -> None:
        at = _bits(keys, 8 * len(self.bytes)).ravel()
        np.bitwise_or.at(self.bytes, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


class Seen(StatefulProcessor):
    """A shard of the keys seen: those of the last `ttl_ms` exactly, older ones in two filters of `capacity` keys each.

    When the younger filter is full it becomes the older one, and what that held is forgotten.  The exact keys are read
    only if the filters know one of the keys that arrive, or have forgotten some that are still among the exact ones.
    """

    def __init__(self, ttl_ms: int, capacity: int, names: list[str]):
        """names: of what is given back, the verdict last; a row's key stands where the verdict will."""
        self.ttl_ms, self.capacity, self.names, self.key = ttl_ms, capacity, names, len(names) - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.exact = handle.getListState("exact", "keys binary", self.ttl_ms)
        self.filters = handle.getValueState("filters", "young binary, old binary, n bigint, forgot bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        young, old, n, forgot = self.filters.get() if self.filters.exists() else (None, None, 0, -self.ttl_ms)
        now = timerValues.getCurrentProcessingTimeInMs()
        young, old = Filter(self.capacity, young), Filter(self.capacity, old)
        exact, fresh = None, np.zeros(0, np.uint64)
        for some in batched(rows, CHUNK):
            # null texts have no key and pass
            yield from (self._with(r, "new") for r in some if r[self.key] is None)
            some = list({r[self.key]: r for r in reversed(some) if r[self.key] is not None}.values())
            keys = np.array([r[self.key] for r in some], np.int64).view(np.uint64)
            maybe = young.holds(keys) | old.holds(keys)
            if exact is None and (maybe.any() or now < forgot + self.ttl_ms):
                exact = np.concatenate([fresh[:0], *(np.frombuffer(k, np.uint64) for (k,) in self.exact.get())])
            certain = np.isin(keys, fresh)
            if exact is not None:
                certain |= np.isin(keys, exact)
            yield from (self._with(r, "maybe" if m else "new") for r, m, c in zip(some, maybe, certain, strict=True) if not c)
            keys = keys[~certain]
            fresh = np.concatenate([fresh, keys])
            adding = keys[~young.holds(keys)]
            while len(adding):
                part, adding = adding[: self.capacity - n], adding[self.capacity - n :]
                young.add(part)
                n += len(part)
                if n == self.capacity:
                    forgot = now if old.bytes.any() else forgot
                    young, old, n = Filter(self.capacity, None), young, 0
        if len(fresh):
            self.exact.appendValue((fresh.tobytes(),))
            self.filters.update((young.bytes.tobytes(), old.bytes.tobytes(), n, forgot))

    def _with(self, row: Row, verdict: str) -> Row:
        return Row(*self.names)(*row[: self.key], verdict)

    def close(self) -> None:
        pass


def dedup_bounded(stream: DataFrame, text: str = "text", ttl_ms: int = 7 * 86_400_000, capacity: int = 1 << 20, shards: int = 4096, verdict: str = "seen") -> DataFrame:
    """stream with `verdict`, without texts that have certainly come before; state is bounded.

    new: not seen among what is remembered.  maybe: the text's key isn't among those of the last `ttl_ms` (of processing time), but a
    filter of older keys has it: seen before, or, for about 1 in 1,000 new texts while both filters are full, taken for it.
    What comes twice within `ttl_ms` is given once.  An older text that the filters have let go too (after `capacity` to 2 * `capacity`
    other texts in its shard) is new again.  Whoever wants no text lost keeps both; whoever wants no text twice, `new` alone.

    State is 8 bytes for each text of the last `ttl_ms` and 4 * BITS / 16 bytes for each of `shards` * `capacity` texts.  No time of the
    record's own is asked, so late records are judged like others.  Null texts all pass, as new.  Of copies in one
    micro-batch one stays, any.  Texts of one 64-bit key count as one.  Copies within a batch of a task go before the shuffle, so that a
    text that is a third of all rows isn't a hot shard.  `shards`, `capacity` and the columns must stay the same for a checkpoint's life.
    Columns named _key, _shard or like `verdict`, or
    twice the same, are refused.
    """
    if clash := {"_key", "_shard", verdict} & set(stream.columns):
        raise ValueError(f"columns {sorted(clash)} are needed for the verdict")
    if len(set(stream.columns)) < len(stream.columns):
        raise ValueError(f"columns of one name: {stream.columns}")
    spark = stream.sparkSession
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            raise ValueError(f"set {name} to {value}")
    number = F.when(F.col(text).isNotNull(), F.xxhash64(digest(F.col(text))))
    keyed = stream.withColumn("_key", number)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index("_key"))
            null = keys.is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~null)
            first = at[np.unique(keys.drop_null().to_numpy(), return_index=True)[1]]
            yield b.take(pa.array(np.sort(np.concatenate([first, np.flatnonzero(null)]))))

    once_a_batch = keyed.mapInArrow(once, keyed.schema)
    # null texts are spread by their other columns; xxhash64 passes over nulls
    others = [F.col(c).cast("string") for c in stream.columns if c != text] or [F.lit(0)]
    shard = F.pmod(F.xxhash64(F.coalesce(F.col("_key"), F.xxhash64(*others))), F.lit(shards))
    out = StructType([*stream.schema.fields, StructField(verdict, StringType())])
    grouped = once_a_batch.withColumn("_shard", shard).groupBy("_shard")
    return grouped.transformWithState(Seen(ttl_ms, capacity, out.names), out, "Append", "ProcessingTime")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to Parquet and stop; the checkpoint lets a later call go on from there, each record written once."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
