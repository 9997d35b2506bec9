"""Best-fit packing by hierarchical residual packing.

Rows are dealt out in turn, so that each partition has a like mix of lengths, however the input lies.  Each
partition tokenises its documents, cuts those longer than a sequence into pieces and packs its
pieces best-fit decreasing; where it has more than HELD bytes of ids, it does so part by part, each like a partition of its own.  Bins that are full but for SLACK tokens are done.  The others become items
themselves: FAN partitions' underfull bins meet in one group, are packed best-fit again, and so on
up the tree to a single group, where what is left is done as it is.

A group passes on its CARRY emptiest underfull bins at most.  That costs no sequence: bins move whole, and of
the bins of a best-fit packing one at most is half full or less (two such would have been one), so FAN groups bring
FAN bins at most that can go into others; what any bin fits into, one of the emptiest takes as well.

The pieces' ids are written once, to the shared folder, by the partition that made them.  Those of bins done there
stay as they are; the tree moves lengths and places alone, and the ids of pieces that went up it are joined
to their last places at the end.

Ids are those that the tokenizers library gives; most words take a way through tiktoken running the file's own
merges (tokens.py), which tests hold against the library.

Defined results: a null text is an empty one, and an empty text is the end-of-document id alone.  Each row is
packed, whether repeated or with a null id.  A text of any length is cut into as many pieces as it takes.  Other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import materialise
from quarry.llm.tokens import encoder

CAPACITY = 4096
EOD = 1
SLACK = 8
FAN = 8
CARRY = 4096
#: Bytes of ids that a task holds before it packs them.
HELD = 64 << 20

#: home, row: which piece (the partition that made it, its number there); used: tokens in the bin; place: where in the
#: bin the piece begins; part, bin: which bin.
SCHEMA = "home bigint, row bigint, part bigint, bin bigint, place bigint, used bigint, done boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [*[pa.int64()] * 6, pa.bool_()]
#: What stays at home; ids: little-endian unsigned 32-bit.
OWN = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
OWN_NAMES = [x.split()[0] for x in OWN.split(", ")]
OWN_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
#: Rows of a batch: 16 MB of ids at CAPACITY.
ROWS = 1024


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, place) of each length, longest first; tokens used in each bin."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    used: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with room for r more
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(used), capacity
            used.append(0)
        out[i] = (b, used[b])
        used[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return out, used


def _done(used: list[int], last: bool, capacity: int, slack: int, carry: int) -> list[bool]:
    if last:
        return [True] * len(used)
    under = sorted((b for b, n in enumerate(used) if n < capacity - slack), key=lambda b: used[b])
    out = [True] * len(used)
    for b in under[:carry]:
        out[b] = False
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, carry: int = CARRY, most: int = HELD) -> DataFrame:
    """Each partition's pieces, with their ids, in its own bins."""

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        part, held = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            places, used = best_fit([r[3] for r in rows], capacity)
            done = _done(used, False, capacity, slack, carry)
            for k in range(0, len(rows), ROWS):
                some = [(*r, part, k + j, part, p[0], p[1], used[p[0]], done[p[0]]) for j, (r, p) in enumerate(zip(rows[k : k + ROWS], places[k : k + ROWS], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), OWN_TYPES + TYPES, strict=True)], names=OWN_NAMES + NAMES)

        for b in batches:
            for k in range(0, b.num_rows, 256):
                texts = b.column(1).slice(k, 256).cast(pa.large_binary()).to_pylist()
                for doc, ids in zip(b.column(0).slice(k, 256).to_pylist(), encode([t or b"" for t in texts]), strict=True):
                    ids += EOD.to_bytes(4, "little")
                    size = len(ids) // 4
                    rows += [(doc, i, s, min(capacity, size - s), ids[4 * s : 4 * (s + capacity)]) for i, s in enumerate(range(0, size, capacity))]
                    held += len(ids)
                    if held >= most:
                        yield from packed()
                        rows, held, part = [], 0, part + n
        yield from packed()

    # the high bits of the id are the partition's number, the low ones the row's in it
    turn = F.monotonically_increasing_id()
    dealt = docs.select("doc_id", "text", turn.alias("_turn")).repartitionById(n, F.expr(f"CAST((_turn % (1L << 33) + _turn DIV (1L << 33)) % {n} AS INT)"))
    return dealt.select("doc_id", "text").mapInArrow(work, f"{OWN}, {SCHEMA}")


def _merge(level: int, last: bool, capacity: int, slack: int, carry: int):
    def work(key, bins):
        group = key[0].as_py()
        rows = bins.select(NAMES).to_pydict()
        keys = list(zip(rows["part"], rows["bin"], strict=True))
        items = dict(sorted(zip(keys, rows["used"], strict=True)))
        places, used = best_fit(list(items.values()), capacity)
        done = _done(used, last, capacity, slack, carry)
        at = dict(zip(items, places, strict=True))
        rows["place"] = [at[k][1] + p for k, p in zip(keys, rows["place"], strict=True)]
        rows["bin"] = [at[k][0] for k in keys]
        rows["part"] = [group] * len(keys)
        rows["used"] = [used[b] for b in rows["bin"]]
        rows["done"] = [done[b] for b in rows["bin"]]
        return pa.Table.from_arrays([pa.array(rows[n], t) for n, t in zip(NAMES, TYPES, strict=True)], names=NAMES)

    return work


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, fan: int = FAN, carry: int = CARRY, most: int = HELD) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    own = materialise(pieces(docs, tokenizer, capacity, slack, carry, most))
    parts = (own.agg(F.max("part").alias("n")).first()["n"] or 0) + 1

    def said(level: int) -> list[Column]:
        return [(F.lit(level << 56) + F.col("part") * (1 << 28) + F.col("bin")).alias("sequence_id"), F.col("place").alias("offset")]

    table, level, moved = own.select(NAMES), 0, []
    while True:
        if level:
            moved.append(table.where("done").select("home", "row", *said(level)))
            if parts == 1:
                break
        level, parts = level + 1, -(-parts // fan)
        groups = table.where("NOT done").withColumn("_group", F.expr(f"part DIV {fan}")).groupBy("_group")
        table = materialise(groups.applyInArrow(_merge(level, parts == 1, capacity, slack, carry), SCHEMA))
    far = own.where("NOT done").select(*OWN_NAMES, "home", "row").join(functools.reduce(DataFrame.union, moved), ["home", "row"])
    whole = own.where("done").select(*OWN_NAMES, *said(0)).union(far.select(*OWN_NAMES, "sequence_id", "offset"))
    return whole.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each packed sequence: sequence_id, length, ids of its pieces one after the other."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("of"), F.sum("length").alias("length"))
    ids = F.unhex(F.array_join(F.transform("of", lambda x: F.hex(x["ids"])), ""))
    return whole.select("sequence_id", "length", ids.alias("ids"))
