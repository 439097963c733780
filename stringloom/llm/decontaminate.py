"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 10-word windows of the benchmark items (a shorter item is one pattern).  For each pattern length there is a
table: shifts by the hash of a block of two words say how far a search may jump, zero shifts lead to the bucket of patterns
with that suffix block and their prefix block, and the words themselves are compared before an occurrence counts.  All texts
of a batch are searched in step: one jump for every text strip at a time, as array operations.

The tables hold the benchmark, not the corpus.  They are broadcast in blocks of at most `BLOCK_BYTES` of item text; with more
than one block the hits found so far are written to the shared folder between passes, so memory is bounded by one block.

Defined results: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; a null or empty text has no words and no
hits; an item without words never occurs; repeated item ids count once; rows are judged one by one, so repeated rows repeat
their result; further columns are ignored by `hits` and kept by `clean_documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.shared import bounded_batches, written
from stringloom.llm.textkit import LOWER, NOT_ALNUM, U64, covered, gram_hashes, groups_of_bytes, mixed, text_buffer, tidy, word_hashes, word_spans

WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
STRIP = 256
TABLE_BITS = 20
HIT_FIELDS = "n_words long, spans binary, items array<string>"


def normal(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


class Patterns:
    """Shift and bucket tables for the patterns of one length."""

    def __init__(self, length: int, hashes: np.ndarray, owners: list[set[str]], words: list[bytes]):
        self.length, self.block = length, min(2, length)
        self.hashes, self.owners, self.words = hashes, owners, words
        self.mask = U64((1 << TABLE_BITS) - 1)
        n = length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, n, np.uint8 if n < 256 else np.int32)
        for at in range(n):
            code = (self.blocks(hashes[:, at : at + self.block]) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, code, n - 1 - at)
        # buckets: patterns by the full hash of their suffix block and prefix block
        self.order_key = self.pair(self.blocks(hashes[:, :self.block]), self.blocks(hashes[:, n - 1 :]))
        order = np.argsort(self.order_key, kind="stable")
        self.order, self.order_key = order, self.order_key[order]

    @staticmethod
    def blocks(two: np.ndarray) -> np.ndarray:
        return gram_hashes(two.ravel(), two.shape[1])[:: two.shape[1]] if two.size else np.zeros(0, U64)

    @staticmethod
    def pair(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return mixed(prefix * U64(0x9E3779B97F4A7C15) + suffix)

    def search(self, words: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, pattern) of candidate occurrences; every position is covered by one strip's search."""
        m, b = self.length, self.block
        n = len(words)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = gram_hashes(words, b)
        shift = self.shift[(grams & self.mask).astype(np.int64)]
        # a strip owns window starts [lo, hi); windows of other texts are dropped by `valid`
        lo = np.arange(0, n - m + 1, STRIP, dtype=np.int64)
        hi = np.minimum(lo + STRIP, n - m + 1)
        at, found = lo.copy(), []
        live = np.arange(len(lo))
        while len(live):
            jump = shift[at[live] + (m - b)].astype(np.int64)
            stop = jump == 0
            if stop.any():
                found.append(at[live[stop]])
            at[live] += np.maximum(jump, 1)
            live = live[at[live] < hi[live]]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.concatenate(found)
        end_of = word_off[np.searchsorted(word_off, start, "right")]
        start = start[start + m <= end_of]
        key = self.pair(grams[start], grams[start + m - b])
        left, right = np.searchsorted(self.order_key, key, "left"), np.searchsorted(self.order_key, key, "right")
        many = right - left
        start, left, many = start[many > 0], left[many > 0], many[many > 0]
        which = self.order[np.repeat(left, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
        start = np.repeat(start, many)
        same = (words[start[:, None] + np.arange(m)] == self.hashes[which]).all(axis=1) if len(start) else np.zeros(0, bool)
        return start[same], which[same]


def pattern_tables(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Tables by pattern length for (item_id, text) rows."""
    by_length: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        raw = normal(np.frombuffer((text or "").encode(), np.uint8))
        starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), NOT_ALNUM) if len(raw) else (np.zeros(0, int),) * 3
        words = [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(b" ".join(words[at : at + size]), set()).add(str(item))
    tables = []
    for size, patterns in sorted(by_length.items()):
        texts = list(patterns)
        flat = np.frombuffer(b" ".join(texts), np.uint8)
        starts, ends, _ = word_spans(flat, np.array([0, len(flat)]), NOT_ALNUM)
        tables.append(Patterns(size, word_hashes(flat, starts, ends).reshape(len(texts), size), [patterns[t] for t in texts], texts))
    return tables


def batch_hits(texts: pa.Array, tables: list[Patterns]) -> tuple[list[int], list[list[int]], list[set[str]]]:
    """For each text: number of words, hit word spans as (start, length, ...) and the items that occur."""
    raw, off = text_buffer(texts)
    n_words: list[int] = []
    spans: list[list[int]] = []
    items: list[set[str]] = []
    for a, z in groups_of_bytes(off, 1 << 19):
        data = normal(raw[off[a] : off[z]])
        local = off[a : z + 1] - off[a]
        starts, ends, word_off = word_spans(data, local, NOT_ALNUM)
        words = word_hashes(data, starts, ends)
        base = len(n_words)
        n_words += np.diff(word_off).tolist()
        spans += [[] for _ in range(z - a)]
        items += [set() for _ in range(z - a)]
        for table in tables:
            at, which = table.search(words, word_off)
            docs = np.searchsorted(word_off, at, "right") - 1
            for i, p, d in zip(at.tolist(), which.tolist(), docs.tolist(), strict=True):
                # the direct comparison: the words themselves, not their hashes
                if b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + table.length].tolist(), ends[i : i + table.length].tolist(), strict=True)) == table.words[p]:
                    spans[base + d] += (i - int(word_off[d]), table.length)
                    items[base + d] |= table.owners[p]
    return n_words, spans, items


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """Benchmark rows in blocks of about `block_bytes`, one after another."""
    block: list[tuple[object, str | None]] = []
    size = 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        block.append((item, text))
        size += len(text or "") * 2 + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, hit_col: str = "hit") -> DataFrame:
    """All columns of `docs` plus `hit struct<n_words, spans, items>` (an input column of that name is replaced); spans are
    int32 pairs (first word, words)."""
    state = bounded_batches(docs).withColumn(hit_col, F.lit(None).cast(f"struct<{HIT_FIELDS.replace(' long', ':long').replace(' binary', ':binary').replace(' array', ':array')}>"))
    context = docs.sparkSession.sparkContext
    first = True
    for block in _item_blocks(benchmark, block_bytes):
        if not first:
            state = written(state, "decontaminate")
        state, first = _pass(state, hit_col, context.broadcast(pattern_tables(block, window))), False
    return _pass(state, hit_col, context.broadcast([])) if first else state


def _pass(state: DataFrame, hit_col: str, tables) -> DataFrame:
    names = state.columns
    at, text_at = names.index(hit_col), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tables.value
        for batch in batches:
            n_words, spans, items = batch_hits(batch.column(text_at), patterns)
            before = batch.column(at).to_pylist()
            out = [
                {"n_words": n, "spans": np.array(s, np.int32).tobytes() + (b["spans"] if b else b""), "items": sorted(i | set(b["items"] if b else ()))}
                for n, s, i, b in zip(n_words, spans, items, before, strict=True)
            ]
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))])
            columns = [c if k != at else pa.array(out, kind) for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return state.mapInArrow(tidy(run), state.schema)


def hit_words(n: int, spans: bytes) -> int:
    s = np.frombuffer(spans, np.int32).reshape(-1, 2)
    return int(covered(n, s[:, 0], s[:, 1]).sum()) if len(s) else 0


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns for each document."""
    found = hits(docs.select("doc_id", "text"), benchmark).select("doc_id", "hit")
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column(1).to_pylist()
            n_hit = [hit_words(h["n_words"], h["spans"]) for h in hit]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h["n_words"] for h in hit], pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(h["items"]) for h in hit], pa.int64()),
                    pa.array([hashlib.sha256(",".join(h["items"]).encode()).hexdigest() for h in hit]),
                    pa.array([n > 0 for n in n_hit]),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs, with the columns of `docs`."""
    hit = max(docs.columns, key=len) + "_hit"
    return hits(docs, benchmark, hit_col=hit).where(F.size(f"{hit}.items") == 0).drop(hit)
