"""Substring dedup by suffix automata of reference shards.

Each document is streamed through suffix automata of the text of documents with smaller ids.  The automaton gives matching
statistics, that is, for each word the length of the longest match that ends there; every window of 13 words with a match of
at least 13 is removed, as the maximal spans these windows cover.

`without_reference` does so against a stated, bounded reference (licence texts, site furniture): its shards' automata are
broadcast one after another, and all documents are streamed through each.

In `op9` and `without_repeats` the reference of a document is every document with a smaller id, so it has no size bound and is
not broadcast.  Instead it is cut into shards by content (see `repeats`): a shard holds the segments of all documents that have one rare word group, which
are the only ones its windows can occur in.  A shard's automaton starts empty, and segments come in order of document id:
first streamed, then added, so what is in the automaton always is the text of smaller ids.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; null or empty texts have none; texts under 13 words lose nothing; rows that
share a document id count as one document (never earlier than each other); a null id is earlier than all others; further
columns are kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.blocks import Blocks
from stringloom.llm.repeats import Block, Kind, Symbols, covered, covered_symbols
from stringloom.llm.shared import bounded_batches, written
from stringloom.llm.textkit import U64, WHITE, span_index, text_buffer, tidy, word_hashes, word_spans
from stringloom.llm.textkit import covered as covered_places

WINDOW = 13
#: Words of a minimizer group: a window has WINDOW - GRAM + 1 of them.
GRAM = 4
#: Words whose bytes are indexed at once.
SLICE = 1 << 15
#: Text of a broadcast reference shard; its automaton takes some 150 times that in a worker.
REFERENCE_BYTES = 1 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over words; states grow with the words added."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _state(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The state for the longest string of `state` plus `word`, taken out of `target` if that holds longer ones."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return self._split(last, word, target)
        own = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = own
            state = self.link[state]
        if state >= 0:
            self.link[own] = self._split(state, word, self.next[state][word])
        return own

    def matching_statistics(self, words: list[bytes]) -> list[int]:
        """Length of the longest match that ends at each word."""
        follow, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                size = length[state]
            target = follow[state].get(word)
            if target is not None:
                state = target
                size += 1
            out.append(size)
        return out


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    starts, ends, word_offsets = word_spans(data, offsets, WHITE)
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    # the words and a space after each; in slices, since the index has eight bytes for each one of text
    joined = np.full(int(sizes.sum()), 0x20, np.uint8)
    for a in range(0, len(starts), SLICE):
        here = slice(a, a + SLICE)
        index, inside = span_index(starts[here], sizes[here] - 1)
        joined[inside + np.repeat(first[here], sizes[here] - 1)] = data[index]
    return Symbols(lambda: word_hashes(data, starts, ends), word_offsets, joined.tobytes(), first, first + sizes - 1)


def judged(texts: list[bytes], keys: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A shard's masks: bit j of a segment is set if the window from its word j on occurs in a smaller document id."""
    del starts
    out = np.zeros(len(texts), U64)
    order = np.lexsort((ids, keys))
    key_at, id_at = keys[order].tolist(), ids[order].tolist()
    n = len(order)
    i = 0
    order_list = order.tolist()
    while i < n:
        key = key_at[i]
        automaton, seen = SuffixAutomaton(), {}
        while i < n and key_at[i] == key:
            document = id_at[i]
            group = []
            while i < n and key_at[i] == key and id_at[i] == document:
                group.append(order_list[i])
                i += 1
            fresh = []
            for at in group:
                text = texts[at]
                before = seen.get(text)
                # once a whole segment has matched it always will: the automaton only grows
                if before is None or not before:
                    words = text.split(b" ")
                    sizes = automaton.matching_statistics(words)
                    mask = 0
                    for j in range(len(words) - WINDOW + 1):
                        if sizes[j + WINDOW - 1] >= WINDOW:
                            mask |= 1 << j
                    out[at] = mask
                    if before is None:
                        fresh.append((text, words))
                    elif mask == (1 << len(words) - WINDOW + 1) - 1:
                        seen[text] = mask
                else:
                    out[at] = before
            for text, words in fresh:
                if text not in seen:
                    seen[text] = 0
                    automaton.add(words)
    return out


KIND = Kind(WINDOW, GRAM, word_symbols, judged, True)


def word_masks(docs: DataFrame, kind: Kind = KIND) -> tuple[Blocks, dict[str, DataFrame]]:
    blocks = Blocks(docs, "substring_blocks")
    return blocks, covered_symbols(blocks, kind)


def kept_texts(s: Symbols, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, removed words, kept words joined by one space) of each row."""
    n_words = np.diff(s.offsets)
    before = np.concatenate([[0], np.cumsum(gone)])
    n_gone = before[s.offsets[1:]] - before[s.offsets[:-1]]
    kept = np.flatnonzero(~gone)
    sizes = s.last[kept] - s.first[kept] + 1
    # a kept word's bytes and the space after it
    raw = np.frombuffer(s.buffer, np.uint8)
    text = b"".join(raw[span_index(s.first[kept[a : a + SLICE]], sizes[a : a + SLICE])[0]].tobytes() for a in range(0, len(kept), SLICE))
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(kept, s.offsets)].tolist()
    return n_words, n_gone, [text[a : max(a, z - 1)] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def op9(docs: DataFrame, kind: Kind = KIND) -> DataFrame:
    blocks, replies = word_masks(docs.select("doc_id", "text"), kind)
    n_buckets = blocks.n_buckets

    def finish(rows: pa.RecordBatch, have: dict[str, bytes]) -> pa.RecordBatch:
        block = Block(rows, kind)
        n_words, n_gone, texts = kept_texts(block.symbols, covered(block, have, n_buckets))
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return blocks.finished(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", replies)


def without_repeats(docs: DataFrame, kind: Kind = KIND) -> DataFrame:
    """`docs` with repeated spans removed from `text`: a text that loses words becomes its kept words joined by one space,
    any other text stays as it is.  All rows and columns stay."""
    blocks, replies = word_masks(docs, kind)
    n_buckets = blocks.n_buckets
    at = docs.columns.index("text")

    def finish(rows: pa.RecordBatch, have: dict[str, bytes]) -> pa.RecordBatch:
        block = Block(rows, kind)
        _, n_gone, texts = kept_texts(block.symbols, covered(block, have, n_buckets))
        old = rows.column(at).to_pylist()
        new = pa.array([t.decode() if n else o for t, n, o in zip(texts, n_gone.tolist(), old, strict=True)], rows.column(at).type)
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(rows.columns)], schema=rows.schema)

    return blocks.finished(finish, docs.schema, replies)


def without_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """`docs` with every span of `window` and more words that occurs in one text of `reference(text)` cut out of `text`; a text
    that loses words becomes its kept words joined by one space.  All rows and columns stay, null texts stay null.

    The reference is dealt into shards by the hash of its texts, one automaton each.  A pass broadcasts one and marks what it
    covers in every document; the marks are written between passes and the texts are cut after the last, so spans are judged on
    the input.  A text of the reference is not cut, so the longest one bounds a shard from below."""
    spark = docs.sparkSession
    texts = reference.select("text").where("text IS NOT NULL").distinct()
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    texts = written(texts.select("text", F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard")), "reference")
    marks = max(docs.columns, key=len) + "_marks"
    rows = docs.withColumn(marks, F.lit(None).cast("binary"))
    for i in range(shards):
        automaton = SuffixAutomaton()
        for row in texts.where(F.col("shard") == i).orderBy("text").toLocalIterator():
            data, offsets = text_buffer(pa.array([row.text]))
            automaton.add(_words(word_symbols(data, offsets), 0))
        shared = spark.sparkContext.broadcast(automaton)
        rows = written(_marked(rows, shared, window, marks), "reference-marks")
        shared.destroy()
    names, at, mark = docs.columns, docs.columns.index("text"), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = word_symbols(*text_buffer(batch.column(at)))
            gone = [_unpacked(m, n) for m, n in zip(batch.column(mark).to_pylist(), np.diff(symbols.offsets).tolist(), strict=True)]
            _, n_gone, kept = kept_texts(symbols, np.concatenate([np.zeros(0, bool), *gone]))
            new = [k.decode() if n else old for k, n, old in zip(kept, n_gone.tolist(), batch.column(at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:mark])], names=names)

    return bounded_batches(rows).mapInArrow(tidy(cut), docs.schema)


def _words(s: Symbols, row: int) -> list[bytes]:
    a, z = s.offsets[row : row + 2]
    return s.buffer[s.first[a] : s.last[z - 1]].split(b" ") if a < z else []


def _unpacked(marks: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, bool) if marks is None else np.unpackbits(np.frombuffer(marks, np.uint8), count=n).astype(bool)


def _marked(rows: DataFrame, shared, window: int, marks: str) -> DataFrame:
    """`rows` with the words that the broadcast automaton covers marked, as bits, beside those marked before."""
    at, mark = rows.columns.index("text"), rows.columns.index(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            symbols = word_symbols(*text_buffer(batch.column(at)))
            out = []
            for i, old in enumerate(batch.column(mark).to_pylist()):
                words = _words(symbols, i)
                ends = np.flatnonzero(np.array(automaton.matching_statistics(words), np.int64) >= window)
                if len(ends):
                    gone = _unpacked(old, len(words)) | covered_places(len(words), ends - window + 1, np.full(len(ends), window))
                    old = np.packbits(gone).tobytes()
                out.append(old)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if i == mark else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return bounded_batches(rows).mapInArrow(tidy(run), rows.schema)
