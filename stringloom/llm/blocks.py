"""Blocks of rows and packed exchanges between them.

A block is some neighbouring rows of a table, about `BLOCK_BYTES` of text, kept as one compressed Arrow message in one cell of
a table bucketed by block.  An operator goes over the blocks several times; each time the rows are the same and in the same
order, so what another pass worked out for a block can be matched by position.

A packed exchange sends, from each block, one row for each bucket of keys, with the block's distinct keys of that bucket (and
what belongs to them) as one binary value; each bucket answers each block with one binary value in the same order.  So keys
are aggregated inside a block before they are shuffled, a hot key costs one entry a block, and the shuffle moves packed
numbers.  Buckets are ranges of a mixed hash; their number follows the bytes of text, so a bucket's size does not grow.

Growth: a message holds at least one key, so there are never more messages than distinct keys of blocks, a number that is in
proportion to the text.  Up to then they are blocks times buckets, and a message of k keys spreads its row's 40 bytes over
them: about 500 keys at 1 GB of text, 10 at 50 GB, and single keys from half a TB on, where the exchange costs what a plain
shuffle of (key, block) rows costs.  A task holds one bucket's messages or one block at a time, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.shared import bounded_batches, bucketed, shuffle_partitions
from stringloom.llm.textkit import U64, groups_of_bytes, text_buffer, tidy

#: Text bytes of a block.  A longer text is a block of its own; larger executors may take larger blocks.
BLOCK_BYTES = 2 << 20
#: Text bytes for each bucket of keys, which one task holds at once.
BUCKET_BYTES = 8 << 20
#: Text bytes for each bucket of the table of blocks.
TABLE_BYTES = 64 << 20

Emit = Callable[[pa.RecordBatch, int, dict[str, bytes], int], Iterator[tuple[int, bytes]]]


def packed_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_rows(payload: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(payload).read_all()
    return table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


class Blocks:
    """The blocks of a table of documents."""

    def __init__(self, docs: DataFrame, label: str, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES):
        spark = docs.sparkSession
        self.schema = docs.schema
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, pending, size = TaskContext.get().partitionId() << 32, [], 0
            for batch in batches:
                offsets = text_buffer(batch.column(at))[1]
                for a, z in groups_of_bytes(offsets, block_bytes):
                    pending.append(batch.slice(a, z - a))
                    size += int(offsets[z] - offsets[a])
                    if 4 * size >= 3 * block_bytes:
                        yield block(number, pending)
                        number, pending, size = number + 1, [], 0
            if pending:
                yield block(number, pending)

        def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*(p.columns for p in parts), strict=True)], schema=parts[0].schema)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed_rows(rows)], pa.binary())], names=["block", "payload"])

        total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        self.n_buckets = max(shuffle_partitions(spark), -(-total // bucket_bytes))
        self.n_tasks = max(shuffle_partitions(spark), -(-total // TABLE_BYTES))
        self.table = bucketed(bounded_batches(docs).mapInArrow(tidy(run), "block long, payload binary"), label, "block", self.n_tasks)

    def with_replies(self, replies: dict[str, DataFrame]) -> DataFrame:
        """The blocks with, for each named exchange, its answers as `array<struct<bucket, reply>>`.

        Replies come to where the bucketed table has their block, so the blocks stay in place.  A task builds a hash table of
        its replies, which are those of about `TABLE_BYTES` of text whatever the size of the data."""
        rows = self.table
        for name, reply in replies.items():
            each = reply.repartition(self.n_tasks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
            rows = rows.join(each.hint("shuffle_hash"), "block", "left")
        return rows

    def exchange(self, emit: Callable[[pa.RecordBatch, dict[str, bytes]], Iterator[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]], replies: dict[str, DataFrame] | None = None) -> DataFrame:
        """`block, bucket, reply`.  `emit(rows, replies)` gives (bucket, message) pairs of a block; `answer(messages)` gives
        one reply for each message of a bucket."""
        names, routes = list(replies or {}), keys_of_partitions(self.n_buckets)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, rows, have in opened(batches, names):
                out = list(emit(rows, have))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(routes[[b for b, _ in out]]), pa.array([b for b, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([m for _, m in out], pa.binary())],
                    names=["route", "bucket", "block", "message"],
                )

        def respond(group: pa.Table) -> pa.Table:
            group = group.sort_by("block")
            out = answer(group.column("message").to_pylist())
            pa.default_memory_pool().release_unused()
            return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "reply": pa.array(out, pa.binary())})

        sent = self.with_replies(replies or {}).mapInArrow(tidy(send), "route int, bucket int, block long, message binary")
        return sent.repartition(self.n_buckets, "route").groupBy("route").applyInArrow(respond, "block long, bucket int, reply binary")

    def noted(self, note: Callable[[pa.RecordBatch, dict[str, bytes]], bytes], replies: dict[str, DataFrame]) -> DataFrame:
        """`block, bucket, reply` with one value for each block that later passes get back, as if one bucket had replied."""
        names = list(replies)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, rows, have in opened(batches, names):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([note(rows, have)], pa.binary())], names=["block", "bucket", "reply"])

        return self.with_replies(replies).mapInArrow(tidy(run), "block long, bucket int, reply binary")

    def finished(self, finish: Callable[[pa.RecordBatch, dict[str, bytes]], pa.RecordBatch], schema, replies: dict[str, DataFrame]) -> DataFrame:
        """One last pass that turns each block into result rows."""
        names = list(replies)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows, have in opened(batches, names):
                yield finish(rows, have)

        return self.with_replies(replies).mapInArrow(tidy(run), schema)


def opened(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, pa.RecordBatch, dict[str, bytes]]]:
    """(block number, rows, replies joined in bucket order) for each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            pa.default_memory_pool().release_unused()
            have = {}
            for name in names:
                own = batch.column(batch.schema.get_field_index(name))[i].as_py() or []
                have[name] = b"".join(x["reply"] for x in sorted(own, key=lambda x: x["bucket"]))
            yield batch.column(0)[i].as_py(), unpacked_rows(batch.column(1)[i].as_py()), have


def partition_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The partition in which Spark's hash partitioning puts 32-bit integers (Murmur3 with Spark's seed)."""
    u32 = np.uint32
    turned = lambda x, bits: (x << u32(bits)) | (x >> u32(32 - bits))
    k = turned(keys.astype(u32) * u32(0xCC9E2D51), 15) * u32(0x1B873593)
    h = (turned(u32(42) ^ k, 13) * u32(5) + u32(0xE6546B64)) ^ u32(4)
    h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
    h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
    return np.mod((h ^ (h >> u32(16))).view(np.int32).astype(np.int64), n)


def keys_of_partitions(n: int) -> np.ndarray:
    """For each of n partitions an integer that goes there, so that each bucket has a task of its own."""
    out, found, first = np.full(n, -1, np.int32), 0, 0
    while found < n:
        keys = np.arange(first, first + 4 * n + 64, dtype=np.int32)
        place = partition_of(keys, n)
        some, at = np.unique(place, return_index=True)
        fresh = out[some] < 0
        out[some[fresh]] = keys[at[fresh]]
        found, first = found + int(fresh.sum()), first + len(keys)
    return out


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each mixed 64-bit key; grows with the key, so sorted keys are in bucket order."""
    return (((keys >> U64(32)) * U64(n_buckets)) >> U64(32)).astype(np.int64)


def bucket_slices(sorted_keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted keys fall into."""
    if len(sorted_keys):
        own = bucket_of(sorted_keys, n_buckets)
        cuts = np.flatnonzero(np.diff(own)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
            yield int(own[a]), a, z


def planes(values: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second bytes and so on, which a stream compressor can shorten."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(dtype).ravel()
