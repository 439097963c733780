"""Language-model scoring by deleted interpolation of word n-grams.

A token v after u has probability  w2 * c(u v) / c(u) + w1 * c(v) / N + w0 / (V + 1),  with weights of the bucket of c(u) (powers
of two), so rare contexts lean on shorter ones.  Counts are over all training documents.  The weights are learned by
expectation-maximisation on held-out counts: each token of one tenth of the training documents is scored with its own
occurrence deleted from the counts, and the three shares are gathered in a histogram whose size is fixed.

Counting: each block (see `blocks`) sends its distinct unigrams and bigrams with their local counts to the bucket of their
hash; the bucket adds them up and answers with the totals.  Nothing is broadcast, the shuffle grows with the text, and a
frequent word costs one entry a block.  N-grams are compared by 64-bit hashes.

Defined results: A-Z is lower-cased; tokens are `[^\\x20\\x09-\\x0D]+` and one end; null and empty texts are the end alone; a row
with a null id is scored, but neither held out nor learned from; repeated rows count as often as they occur; with no training
tokens the model is uniform over the one unknown token; further columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.blocks import Blocks, bucket_slices, planes, unplanes
from stringloom.llm.shared import written
from stringloom.llm.textkit import LOWER, U64, WHITE, mixed, text_buffer, word_hashes, word_spans

FOLDS = 10
#: The training fold whose tokens, each with its own occurrence deleted, teach the weights.
DELETED_FOLD = 1
BUCKETS = 48
#: Histogram cells to a power of two of a probability ratio, and the largest power kept apart.
CELLS, TOP = 2, 40
ROUNDS = 200
END, BEGIN = U64(0xD1B54A32D192ED03), U64(0xABC98388FB8FAC03)
PAIR = U64(0x9E3779B97F4A7C15)


def fold(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


class Tokens:
    """A block's tokens; keys of unigrams are odd and keys of bigrams even."""

    def __init__(self, rows: pa.RecordBatch):
        raw, offsets = text_buffer(rows.column(rows.schema.get_field_index("text")))
        data = LOWER[raw]
        starts, ends, words = word_spans(data, offsets, WHITE)
        n_docs = len(offsets) - 1
        #: Token offsets of the documents.
        self.offsets = words + np.arange(n_docs + 1)
        token = np.empty(len(starts) + n_docs, U64)
        last = np.zeros(len(token), bool)
        last[self.offsets[1:] - 1] = True
        token[~last], token[last] = word_hashes(data, starts, ends), END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.offsets[:-1]] = BEGIN
        self.unigram = token | U64(1)
        self.bigram = mixed(before * PAIR + token) & ~U64(1)
        self.doc = np.repeat(np.arange(n_docs), np.diff(self.offsets))
        self.folds = [fold(i) for i in rows.column(rows.schema.get_field_index("doc_id")).to_pylist()]
        self.trains = np.array([f not in (None, 0) for f in self.folds], bool)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys in order, index of each unigram and then each bigram in them)."""
        return np.unique(np.concatenate([self.unigram, self.bigram]), return_inverse=True)


def send_counts(rows: pa.RecordBatch, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    tokens = Tokens(rows)
    keys, own = tokens.keys()
    n = np.bincount(own, np.tile(tokens.trains[tokens.doc], 2), len(keys)).astype(np.uint32)
    for bucket, a, z in bucket_slices(keys, n_buckets):
        yield bucket, struct.pack("<q", z - a) + planes(keys[a:z]) + planes(n[a:z])


def add_counts(messages: list[bytes]) -> list[bytes]:
    """Totals for each message; the first reply of a bucket begins with its distinct trained unigrams and their tokens."""
    sizes = [struct.unpack_from("<q", m)[0] for m in messages]
    keys = np.concatenate([unplanes(m[8:], U64, n) for m, n in zip(messages, sizes, strict=True)])
    counts = np.concatenate([unplanes(m[8 + 8 * n :], np.uint32, n) for m, n in zip(messages, sizes, strict=True)])
    unique, own = np.unique(keys, return_inverse=True)
    total = np.bincount(own, counts, len(unique)).astype(np.int64)
    words = (unique & U64(1)).astype(bool) & (total > 0)
    heads = [struct.pack(">qq", int(words.sum()), int(total[words].sum()))] + [struct.pack(">qq", 0, 0)] * (len(messages) - 1)
    return [h + planes(t) for h, t in zip(heads, np.split(total[own], np.cumsum(sizes)[:-1]), strict=True)]


class Counts:
    """A block's tokens with their totals over the training documents: c(v), c(u), c(u v)."""

    def __init__(self, rows: pa.RecordBatch, replies: bytes, n_buckets: int):
        self.tokens = t = Tokens(rows)
        keys, own = t.keys()
        at, parts = 0, []
        for _, a, z in bucket_slices(keys, n_buckets):
            parts.append(unplanes(replies[at + 16 :], np.int64, z - a))
            at += 16 + 8 * (z - a)
        total = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n = len(t.unigram)
        self.word, self.pair = total[own[:n]], total[own[n:]]
        # a context is the word before, and before the first word it is the begin, counted once a training document as the end is
        self.context = np.empty(n, np.int64)
        self.context[1:] = self.word[:-1]
        self.context[t.offsets[:-1]] = self.word[t.offsets[1:] - 1]


def bucket_of_context(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(context, 0).astype(float))[1], BUCKETS - 1)


def ratios(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram maximum-likelihood estimates over the uniform probability."""
    bigram = np.where(context > 0, pair / np.maximum(context, 1), 0.0) * (distinct + 1)
    return bigram, word / max(total, 1) * (distinct + 1)


def cells(r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), np.int64)
    some = r > 0
    out[some] = np.clip(np.floor(CELLS * np.log2(r[some])) + CELLS * TOP, 1, 2 * CELLS * TOP)
    return out


def learned(histogram: list[tuple[int, float, float, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by EM over (bucket, tokens, bigram ratio, unigram ratio).

    One pseudo-token for each weight keeps all of them positive; the unseen context has no bigram weight."""
    out = np.full((BUCKETS, 3), 1 / 3)
    by_bucket: dict[int, list[tuple[float, float, float]]] = {}
    for bucket, n, bigram, unigram in histogram:
        by_bucket.setdefault(bucket, []).append((n, bigram, unigram))
    for bucket, rows in by_bucket.items():
        n, bigram, unigram = np.array(rows).T
        share = np.stack([bigram, unigram, np.ones(len(n))])
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = weight[:, None] * share
            part *= n / part.sum(axis=0)
            weight = part.sum(axis=1) + 1
            weight /= weight.sum()
        out[bucket] = weight
    out[0, 1:] += out[0, 0] / 2
    out[0, 0] = 0
    return out


class Model:
    """Blocks with the counts of their n-grams, totals, and learned weights."""

    def __init__(self, docs: DataFrame):
        self.blocks = blocks = Blocks(docs.select("doc_id", "text"), "language_model_blocks")
        n_buckets = self.n_buckets = blocks.n_buckets

        def send(rows: pa.RecordBatch, _: dict[str, bytes]) -> Iterator[tuple[int, bytes]]:
            return send_counts(rows, n_buckets)

        self.replies = {"counts": written(blocks.exchange(send, add_counts), "language-model-counts")}
        head = lambda at: F.coalesce(F.sum(F.conv(F.hex(F.expr(f"substring(reply, {at}, 8)")), 16, 10).cast("long")), F.lit(0))
        self.distinct, self.total = self.replies["counts"].agg(head(1), head(9)).first()
        self.weights = learned(self.histogram())

    def histogram(self) -> list[tuple[int, float, float, float]]:
        """Held-out tokens by context bucket and by cells of the two ratios, with the mean ratios of each cell."""
        n_buckets, total, distinct = self.n_buckets, self.total, self.distinct

        def run(rows: pa.RecordBatch, have: dict[str, bytes]) -> pa.RecordBatch:
            c = Counts(rows, have["counts"], n_buckets)
            held = np.array([f == DELETED_FOLD for f in c.tokens.folds], bool)[c.tokens.doc]
            context, word, pair = c.context[held] - 1, c.word[held] - 1, c.pair[held] - 1
            bigram, unigram = ratios(pair, context, word, total - 1, distinct)
            side = 2 * CELLS * TOP + 1
            code, own = np.unique((bucket_of_context(context) * side + cells(bigram)) * side + cells(unigram), return_inverse=True)
            columns = [code, *(np.bincount(own, w, len(code)) for w in (np.ones(len(own)), bigram, unigram))]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.float64()) for x in columns[1:])], names=["cell", "n", "bigram", "unigram"])

        parts = self.blocks.finished(run, "cell long, n double, bigram double, unigram double", self.replies)
        side = 2 * CELLS * TOP + 1
        rows = parts.groupBy("cell").agg(*(F.sum(x).alias(x) for x in ("n", "bigram", "unigram"))).collect()
        return [(r.cell // side**2, r.n, r.bigram / r.n, r.unigram / r.n) for r in sorted(rows)]

    def scored(self) -> DataFrame:
        n_buckets, total, distinct, weights = self.n_buckets, self.total, self.distinct, self.weights

        def run(rows: pa.RecordBatch, have: dict[str, bytes]) -> pa.RecordBatch:
            c = Counts(rows, have["counts"], n_buckets)
            at = c.tokens.offsets[:-1]
            bigram, unigram = ratios(c.pair, c.context, c.word, total, distinct)
            w = weights[bucket_of_context(c.context)]
            score = np.log10(w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2]) - math.log10(distinct + 1)
            base = np.log10((c.word + 0.1) / (total + 0.1 * (distinct + 1)))
            sums = [np.add.reduceat(x, at) if len(at) else x for x in ((c.word > 0).astype(np.int64), base, score)]
            return pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([f == 0 for f in c.tokens.folds], pa.bool_()),
                    pa.array(np.diff(c.tokens.offsets), pa.int64()),
                    pa.array(sums[0], pa.int64()),
                    pa.array(np.full(len(at), total), pa.int64()),
                    pa.array(sums[1], pa.float64()),
                    pa.array(sums[2], pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        return self.blocks.finished(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", self.replies)


def op4(docs: DataFrame) -> DataFrame:
    return Model(docs).scored()
