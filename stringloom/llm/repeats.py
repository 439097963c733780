"""Repeated windows of a corpus: which windows of each document also start earlier.

A window is a fixed number of neighbouring symbols (words or bytes) of one document.  Comparing all windows with each other is
routed, so that only pieces of text that can share a window meet:

1. Windows whose least k-gram lies at one place form a segment; the k-gram's hash is the segment's key.  Equal windows have
   equal keys.  A packed exchange tells each block which of its keys occur again (anywhere) and which are hot.
2. Segments of hot keys are taken apart into single windows, keyed by the whole window, and a second exchange of the same kind
   drops the ones that occur once; so a common phrase does not gather all its surroundings in one place.
3. The distinct segments with repeated keys, with their first position in the block, go to the shard of their key.  The shard
   (see `substring_dedup` and `suffix_array_dedup` for the two kinds) answers with a mask of the windows that start earlier.
4. Each block turns the masks into covered symbols.

A later occurrence of a whole segment inside a block starts later than the first, so all its windows are repeated.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.blocks import Blocks, bucket_slices, planes, unplanes
from stringloom.llm.shared import written
from stringloom.llm.textkit import U64, gram_hashes, minimizer_runs, text_buffer

#: Segments of one key beyond which they are taken apart into windows.
HOT = 1000
STRIP = 1 << 16
NULL_ID = -(1 << 63)
ALL = U64((1 << 64) - 1)


class Places:
    """The numbers `ahead`, `ahead + 1`, ... without an array of them."""

    def __init__(self, n: int, ahead: int):
        self.n, self.ahead = n, ahead

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return at + self.ahead


@dataclass
class Symbols:
    """A block's symbols; the content of symbols i..j-1 is `buffer[first[i]:last[j - 1]]`."""

    hashed: Callable[[], np.ndarray]
    offsets: np.ndarray
    buffer: bytes
    first: np.ndarray | Places
    last: np.ndarray | Places

    @cached_property
    def values(self) -> np.ndarray:
        """A number for each symbol; not all passes need them."""
        return self.hashed()


@dataclass
class Kind:
    """How texts become symbols and how a shard judges segments."""

    window: int
    gram: int
    symbols: Callable[[np.ndarray, np.ndarray], Symbols]
    shard: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: Only other documents count as earlier (else earlier places of the same document do too).
    by_document: bool
    hot: int = HOT
    strip: int = STRIP


@dataclass
class Segments:
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray

    def pick(self, at: np.ndarray) -> Segments:
        return Segments(self.doc[at], self.start[at], self.count[at], self.key[at])


def segments(s: Symbols, kind: Kind) -> Segments:
    """All segments of a block; `start` counts symbols from the block's first."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(s.values), kind.strip):
        z = min(len(s.values), a + kind.strip + kind.window - 1)
        inner = s.offsets[(s.offsets > a) & (s.offsets < z)]
        start, count, key = minimizer_runs(s.values[a:z], np.concatenate([[a], inner, [z]]) - a, kind.window, kind.gram)
        parts.append((start + a, count, key))
    start, count, key = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64 if i == 2 else np.int64) for i in range(3))
    return Segments(np.searchsorted(s.offsets, start, "right") - 1, start, count, key)


def single_windows(s: Symbols, kind: Kind, hot: Segments) -> Segments:
    """The windows of hot segments, each a segment keyed by its whole content."""
    total = int(hot.count.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(hot.count) - hot.count, hot.count)
    start = np.repeat(hot.start, hot.count) + inside
    key = np.zeros(total, U64)
    for a in range(0, len(s.values), kind.strip):
        lo, hi = np.searchsorted(start, [a, a + kind.strip])
        if lo < hi:
            key[lo:hi] = gram_hashes(s.values[a : a + kind.strip + kind.window - 1], kind.window)[start[lo:hi] - a]
    return Segments(np.repeat(hot.doc, hot.count), start, np.ones(total, np.int64), key)


def key_message(keys: np.ndarray, docs: np.ndarray, by_document: bool, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((docs, keys))
    unique, first, n = np.unique(keys[order], return_index=True, return_counts=True)
    doc = docs[order]
    several = (doc[first] != doc[first + n - 1]) if by_document else n > 1
    n = np.minimum(n, 65535).astype(np.uint16)
    for bucket, a, z in bucket_slices(unique, n_buckets):
        yield bucket, struct.pack("<q", z - a) + planes(unique[a:z]) + planes(n[a:z]) + several[a:z].tobytes()


def key_answer(messages: list[bytes], hot: int) -> list[bytes]:
    """For each key: 0 if it occurs once, 1 if again, 2 if hot."""
    sizes = [struct.unpack_from("<q", m)[0] for m in messages]
    keys = np.concatenate([unplanes(m[8:], U64, n) for m, n in zip(messages, sizes, strict=True)])
    counts = np.concatenate([unplanes(m[8 + 8 * n :], np.uint16, n) for m, n in zip(messages, sizes, strict=True)])
    several = np.concatenate([np.frombuffer(m, bool, n, 8 + 10 * n) for m, n in zip(messages, sizes, strict=True)])
    _, own = np.unique(keys, return_inverse=True)
    again = (np.bincount(own) > 1) | (np.bincount(own, several) > 0)
    state = np.where(again, 1 + (np.bincount(own, counts) > hot), 0).astype(np.uint8)[own]
    return [x.tobytes() for x in np.split(state, np.cumsum(sizes)[:-1])]


def key_states(keys: np.ndarray, reply: bytes) -> np.ndarray:
    unique, own = np.unique(keys, return_inverse=True)
    return np.frombuffer(reply, np.uint8)[own] if len(unique) else np.zeros(0, np.uint8)


class Block:
    """A block's rows, symbols and the segments that take part."""

    def __init__(self, rows: pa.RecordBatch, kind: Kind):
        self.rows, self.kind = rows, kind
        names = rows.schema.names
        ids = rows.column(names.index("doc_id"))
        self.ids = np.array(ids.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False), np.int64)
        data, offsets = text_buffer(rows.column(names.index("text")))
        self.data, self.text_offsets = data, offsets
        self.symbols = kind.symbols(data, offsets)

    def all_segments(self) -> Segments:
        return segments(self.symbols, self.kind)

    def packed_repeats(self, have: dict[str, bytes]) -> bytes:
        """The segments with repeated keys: first those that are not hot, then the hot ones."""
        own = self.all_segments()
        state = key_states(own.key, have["keys"])
        cold, hot = own.pick(state == 1), own.pick(state == 2)
        columns = [np.concatenate([a, b]) for a, b in ((cold.start, hot.start), (cold.count, hot.count), (cold.key, hot.key))]
        return struct.pack("<qq", len(cold.start), len(hot.start)) + b"".join(map(planes, columns))

    def repeated(self, have: dict[str, bytes]) -> tuple[Segments, Segments]:
        """(segments with repeated keys that are not hot, hot segments)."""
        data = have["segments"]
        cold, hot = struct.unpack_from("<qq", data)
        n = cold + hot
        start, count, key = (unplanes(data[16 + 8 * n * i :], kind, n) for i, kind in enumerate((np.int64, np.int64, U64)))
        both = Segments(np.searchsorted(self.symbols.offsets, start, "right") - 1, start, count, key)
        return both.pick(np.arange(cold)), both.pick(np.arange(cold, n))

    def windows(self, have: dict[str, bytes]) -> Segments:
        """The single windows of hot segments."""
        return single_windows(self.symbols, self.kind, self.repeated(have)[1])

    def judged(self, have: dict[str, bytes]) -> Segments:
        """The segments that go to shards, in order of (document id, start)."""
        cold, single = self.repeated(have)
        if "windows" in have:
            single = single_windows(self.symbols, self.kind, single)
            single = single.pick(key_states(single.key, have["windows"]) > 0)
        both = Segments(*(np.concatenate([getattr(cold, f), getattr(single, f)]) for f in ("doc", "start", "count", "key")))
        return both.pick(np.lexsort((both.start, both.doc, self.ids[both.doc])))

    def contents(self, own: Segments) -> tuple[np.ndarray, list[int], list[bytes]]:
        """(index of each segment's content, first segment of each content, contents) with contents in order of their keys."""
        s, w = self.symbols, self.kind.window
        begin, end = s.first[own.start].tolist(), s.last[own.start + own.count + w - 2].tolist()
        found: dict[bytes, int] = {}
        index = np.empty(len(begin), np.int64)
        firsts: list[int] = []
        for i, (a, z) in enumerate(zip(begin, end, strict=True)):
            text = s.buffer[a:z]
            at = found.setdefault(text, len(firsts))
            if at == len(firsts):
                firsts.append(i)
            index[i] = at
        order = np.argsort(own.key[firsts], kind="stable") if firsts else np.zeros(0, np.int64)
        place = np.empty(len(firsts), np.int64)
        place[order] = np.arange(len(firsts))
        texts = list(found)
        return place[index], [firsts[i] for i in order.tolist()], [texts[i] for i in order.tolist()]


def covered_symbols(blocks: Blocks, kind: Kind) -> dict[str, DataFrame]:
    """Run the exchanges; the replies let `covered` mark the symbols of each block."""
    n_buckets = blocks.n_buckets
    answer_keys = partial(key_answer, hot=kind.hot)

    def send_keys(rows: pa.RecordBatch, _: dict[str, bytes]) -> Iterator[tuple[int, bytes]]:
        own = Block(rows, kind).all_segments()
        return key_message(own.key, own.doc, kind.by_document, n_buckets)

    def send_windows(rows: pa.RecordBatch, have: dict[str, bytes]) -> Iterator[tuple[int, bytes]]:
        own = Block(rows, kind).windows(have)
        return key_message(own.key, own.doc, kind.by_document, n_buckets)

    def send_contents(rows: pa.RecordBatch, have: dict[str, bytes]) -> Iterator[tuple[int, bytes]]:
        block = Block(rows, kind)
        own = block.judged(have)
        _, firsts, texts = block.contents(own)
        first = own.pick(np.array(firsts, np.int64))
        start = first.start - block.symbols.offsets[first.doc]
        sizes = np.array([len(t) for t in texts], np.int32)
        for bucket, a, z in bucket_slices(first.key, n_buckets):
            head = struct.pack("<q", z - a) + planes(first.key[a:z]) + planes(block.ids[first.doc[a:z]]) + planes(start[a:z]) + planes(first.count[a:z]) + planes(sizes[a:z])
            yield bucket, head + b"".join(texts[a:z])

    def judge(messages: list[bytes]) -> list[bytes]:
        keys, ids, starts, counts, texts, sizes = [], [], [], [], [], []
        for m in messages:
            (n,) = struct.unpack_from("<q", m)
            sizes.append(n)
            for i, column in enumerate((keys, ids, starts, counts)):
                column.append(unplanes(m[8 + 8 * n * i : 8 + 8 * n * (i + 1)], U64 if i == 0 else np.int64, n))
            cut = np.cumsum(np.concatenate([[8 + 36 * n], unplanes(m[8 + 32 * n : 8 + 36 * n], np.int32, n)])).tolist()
            texts += [m[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        masks = kind.shard(texts, *(np.concatenate(c) for c in (keys, ids, starts, counts)))
        return [planes(x) for x in np.split(masks, np.cumsum(sizes)[:-1])]

    def select(rows: pa.RecordBatch, have: dict[str, bytes]) -> bytes:
        return Block(rows, kind).packed_repeats(have)

    keys = written(blocks.exchange(send_keys, answer_keys), "repeat-keys")
    replies = {"segments": written(blocks.noted(select, {"keys": keys}), "repeat-segments")}
    any_hot = keys.agg(F.max(F.expr("position(unhex('02'), reply)"))).first()[0]
    if any_hot:
        replies["windows"] = written(blocks.exchange(send_windows, answer_keys, replies), "repeat-windows")
    replies["masks"] = written(blocks.exchange(send_contents, judge, replies).select("block", "bucket", "reply"), "repeat-masks")
    return replies


def covered(block: Block, have: dict[str, bytes], n_buckets: int) -> np.ndarray:
    """Boolean mask of the block's symbols that lie in a window that starts earlier elsewhere."""
    own = block.judged(have)
    index, firsts, _ = block.contents(own)
    n = len(block.symbols.first)
    change = np.zeros(n + 1, np.int32)
    if len(firsts):
        reply, at, masks = have["masks"], 0, []
        # replies come by bucket, each in byte planes of its own
        for _, a, z in bucket_slices(own.key[firsts], n_buckets):
            masks.append(unplanes(reply[at:], U64, z - a))
            at += 8 * (z - a)
        ids, start, leads = block.ids[own.doc], own.start - block.symbols.offsets[own.doc], np.array(firsts)
        lead = ids == ids[leads][index]
        if not block.kind.by_document:
            lead &= start == start[leads][index]
        mask = np.where(lead, np.concatenate(masks)[index], ALL)
        # segments whose windows are all repeated are one span; only the others are taken apart
        full = ALL >> (U64(64) - np.minimum(own.count, 64).astype(U64))
        whole = (mask & full) == full
        np.add.at(change, own.start[whole], 1)
        np.add.at(change, own.start[whole] + own.count[whole] - 1 + block.kind.window, -1)
        some = np.flatnonzero(~whole & (mask != 0))
        for step in range(0, len(some), 1 << 13):
            part = some[step : step + (1 << 13)]
            bits = ((mask[part][:, None] >> np.arange(64, dtype=U64)) & U64(1)).astype(bool) & (np.arange(64) < own.count[part][:, None])
            which, offset = np.nonzero(bits)
            begin = own.start[part][which] + offset
            np.add.at(change, begin, 1)
            np.add.at(change, begin + block.kind.window, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0

