"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each worker streams its documents, encodes them, sends whole windows of a long
document off at once and gathers the rest.  As soon as the gathered pieces fill a
group of windows, differencing packs them: every piece starts as a partial
partition; the two partials with the largest imbalance are merged with opposing
imbalances (the fullest window of one meets the emptiest of the other) until one
partition is left.  Its windows are nearly equal.  If one exceeds the capacity the
window count rises and the group is packed again.

Nothing is shuffled and a task holds two groups at most, however long the
documents are and whatever keys they share.  Sequence ids carry the partition
number, so feed a table whose partitions are stable (files), not a fresh shuffle.

Defined results: null and empty texts are one piece that holds the end id alone;
repeated rows are packed each for itself; other columns are dropped, so clashing
names cannot occur; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.bpe import codec
from quarrylight.llm.common import ship_package

#: Windows that differencing packs together; tokens in the longest piece it gets
#: (finer pieces balance better); tokens a window that a group leaves free for the
#: imbalance that remains.
GROUP, FINEST, SLACK = 128, 512, 10


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal the indices of ``sizes`` into ``windows`` nearly equal lists.

    A partial partition is its windows that hold something, from full to empty."""
    fullest = itemgetter(0)
    # (imbalance, tie-break, windows as (sum, members))
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the fullest of a meet the empty windows of b; what is left meets b's emptiest
        alone = min(len(a), windows - len(b))
        free = len(b) - (len(a) - alone)
        both = [(x + y, own + other) for (x, own), (y, other) in zip(a[alone:], reversed(b[free:]), strict=True)]
        merged = a[:alone] + b[:free] + both
        merged.sort(key=fullest, reverse=True)
        count += 1
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == windows else 0) - merged[0][0], count, merged))
    packed = [members for _, members in heap[0][2]] if heap else []
    return packed + [[] for _ in range(windows - len(packed))]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices, none over the capacity; no size may exceed it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return [w for w in packed if w]
        windows += 1


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, finest: int = FINEST, slack: int = SLACK, checksum: bool = False) -> DataFrame:
    """-> a row per piece: id, ``start``, ``length``, ``ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.  With ``checksum`` their
    CRC-32 (``ids_crc32``, long) stands in for the ids, which then never leave the worker."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = ("doc_tokens", "sequence_id", "offset")
    schema = T.StructType([source.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()) if checksum else T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in longs)])
    finest, slack = min(finest, capacity), min(slack, capacity // 8)
    end = np.array([end_id], "<u4").tobytes()
    given = crc32 if checksum else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, cut=False)  # looking for cuts costs more than it saves here
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            for window in pack_sizes([p[2] for p in pieces], capacity):
                offset = 0
                for i in window:
                    doc_id, start, length, ids, total = pieces[i]
                    out.append((doc_id, start, length, given(ids), total, sequence, offset))
                    offset += length
                sequence += 1

        types: list[pa.DataType] = []
        for rows in batches:
            types = [rows.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64() if checksum else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
                ids = own.encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    out.append((doc_id, start, capacity, given(ids[4 * start : 4 * (start + capacity)]), total, sequence, 0))
                    sequence += 1
                for start in range(whole, total, finest):
                    length = min(finest, total - start)
                    rest.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total))
                    held += length
                # the last group takes what is left, so that none is small
                while held >= 2 * group * capacity:
                    aim = taken = group * (capacity - slack)
                    n = 0
                    while taken >= rest[n][2]:
                        taken -= rest[n][2]
                        n += 1
                    if taken:  # so much of the piece still fits
                        i, start, length, ids, total = rest[n]
                        rest[n : n + 1] = [(i, start, taken, ids[: 4 * taken], total), (i, start + taken, length - taken, ids[4 * taken :], total)]
                        n += 1
                    close(rest[:n])
                    del rest[:n]
                    held -= aim
                if len(out) >= 256:
                    yield batch()
        close(rest)
        if out:
            yield batch()

    return source.mapInArrow(run, schema)
