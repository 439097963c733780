"""Suffix-array dedup by prefix-free parsing.

What can repeat is routed into shards by content (see `repeats`), so a shard's text is highly repetitive.  There, rolling-hash
triggers cut the text into phrases that overlap by one trigger; the distinct phrases are the dictionary, the phrase numbers in
text order are the parse.  No long dictionary suffix is a prefix of another, so two text suffixes compare as their dictionary
suffixes, and where these are equal as the parse suffixes that follow.  Sorting dictionary and parse, and then (dictionary
rank, parse rank) pairs, gives the corpus order of all positions.  Neighbours in that order with 100 equal bytes form one
group; all but a group's earliest member are repeated.

Defined results: texts are UTF-8 bytes, null is empty; texts under 100 bytes lose nothing; rows that share a document id count
as one document (equal places are not earlier than each other); a null id is earlier than all others; a cut inside a character
is kept as bytes by the digests and spans; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stringloom.llm.blocks import Blocks
from stringloom.llm.repeats import Block, Kind, Places, Symbols, covered, covered_symbols
from stringloom.llm.textkit import U64, gram_hashes, span_index

WINDOW = 100
#: Bytes of a minimizer gram: at most 64 windows share one, as many as a mask has bits.
GRAM = 37
TRIGGER = 4
#: Text of one prefix-free parsing; one key's segments may go over it.
PARSE_BYTES = 1 << 18
TRIGGER_EVERY = 8


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    return Symbols(lambda: data, offsets, data.tobytes(), Places(len(data), 0), Places(len(data), 1))


def heads(codes: np.ndarray) -> np.ndarray:
    """For each element, how many are less than it."""
    order = np.argsort(codes)
    fresh = np.ones(len(codes), bool)
    fresh[1:] = codes[order[1:]] != codes[order[:-1]]
    first = np.flatnonzero(fresh)
    out = np.empty(len(codes), np.int64)
    out[order] = np.repeat(first, np.diff(np.append(first, len(codes))))
    return out


def suffix_ranks(codes: np.ndarray, ends: np.ndarray, known: int) -> np.ndarray:
    """For each suffix, how many are less than it; a suffix reaches to its sequence's end in `ends`, and an ended suffix is less
    than any continuation.  `codes` orders the first `known` symbols; prefix doubling does the rest, each round for the
    suffixes that still share their rank."""
    n = len(codes)
    rank = heads(codes)
    while True:
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_):
            return rank
        there = open_ + known
        second = np.where(there < ends[open_], rank[np.minimum(there, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        order = np.argsort(key)
        key, open_ = key[order], open_[order]
        group = rank[open_]
        part = np.append(True, key[1:] != key[:-1])
        whole = np.append(True, group[1:] != group[:-1])
        if part.sum() == whole.sum():
            return rank
        at = np.arange(len(open_))
        rank[open_] = group + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(whole, at, 0))
        known *= 2


def corpus_order(text: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The positions of a collection of strings (or the `wanted` ones of them) in the order of their suffixes."""
    n = len(text)
    starts, lengths = offsets[:-1], np.diff(offsets)
    # phrases begin at string starts and at triggers that lie inside one string
    grams = gram_hashes(text, TRIGGER)
    trigger = np.flatnonzero(grams % U64(TRIGGER_EVERY) == 0)
    own = np.searchsorted(offsets, trigger, "right") - 1
    trigger = trigger[(trigger + TRIGGER <= offsets[own + 1])]
    phrase = np.unique(np.concatenate([starts[lengths > 0], trigger]))
    string = np.searchsorted(offsets, phrase, "right") - 1
    final = np.append(string[1:] != string[:-1], True)
    stop = np.where(final, offsets[string + 1], np.append(phrase[1:], n) + TRIGGER)
    # dictionary: distinct phrases in lexicographic order
    raw = text.tobytes()
    spelled = [raw[a:z] + (b"\x00$" if f else b"") for a, z, f in zip(phrase.tolist(), stop.tolist(), final.tolist(), strict=True)]
    number = {p: i for i, p in enumerate(dict.fromkeys(spelled))}
    of_phrase = np.array([number[p] for p in spelled])
    first = np.full(len(number), -1)
    first[of_phrase[::-1]] = np.arange(len(spelled))[::-1]
    d_start, d_len, d_final = phrase[first], (stop - phrase)[first], final[first]
    # one more symbol for a string's end, below all bytes, so that ended and cut phrases differ
    sizes = d_len + d_final
    index, inside = span_index(d_start, sizes)
    ended = (inside == np.repeat(d_len, sizes)) & np.repeat(d_final, sizes)
    symbols = np.where(ended, 1, text[np.minimum(index, n - 1)].astype(np.int64) + 2)
    d_off = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.repeat(d_off[1:], sizes)
    m = len(symbols)
    ahead, packed, room = np.append(symbols, np.zeros(6, np.int64)), symbols << 54, ends - np.arange(m)
    for step in range(1, 7):
        packed |= np.where(room > step, ahead[step : step + m], 0) << (9 * (6 - step))
    d_rank = suffix_ranks(packed, ends, 7)
    # parse: phrase ranks in text order, a sequence for each string
    word = d_rank[d_off[:-1]][of_phrase]
    begins = np.flatnonzero(np.append(True, string[1:] != string[:-1]))
    p_ends = np.repeat(np.append(begins[1:], len(phrase)), np.diff(np.append(begins, len(phrase))))
    p_rank = suffix_ranks(word, p_ends, 1)
    after = np.where(final, 0, np.append(p_rank[1:], 0) + 1)
    # a position: its phrase's dictionary suffix, then the parse from the next phrase on
    at = np.arange(n) if wanted is None else wanted
    holder = np.cumsum(np.bincount(phrase, minlength=n))[at] - 1
    left = d_rank[(d_off[:-1][of_phrase] - phrase)[holder] + at]
    return at[np.argsort(left * (int(after.max(initial=0)) + 1) + after[holder], kind="stable")]


def window_groups(text: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window positions in suffix order, group of each): equal windows, and only these, share a group."""
    none = np.zeros(0, np.int64)
    if not len(text):
        return none, none
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(text))
    wanted = np.flatnonzero(room >= window)
    if not len(wanted):
        return none, none
    order = corpus_order(text, offsets, wanted)
    eight = np.zeros(len(text), U64)
    for i in range(8):
        eight[: len(text) - 7] = (eight[: len(text) - 7] << U64(8)) | text[i : len(text) - 7 + i].astype(U64)
    same = np.flatnonzero(np.ones(len(order) - 1, bool))
    for step in [*range(0, window - 7, 8), window - 8]:
        same = same[eight[order[same] + step] == eight[order[same + 1] + step]]
    fresh = np.ones(len(order), bool)
    fresh[same + 1] = False
    return order, np.cumsum(fresh) - 1


def judged(texts: list[bytes], keys: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A shard's masks: bit j of a segment is set if the window from its byte j on starts earlier elsewhere.

    Segments of different keys share no window, and one segment does not repeat its own: equal windows have their least grams
    at different places.  So equal segments are one string at its earliest place, a key with one string needs no parsing, and
    the others are taken some at a time."""
    _, rank = np.unique(ids, return_inverse=True)
    place = np.lexsort((starts, rank)).tolist()
    found: dict[bytes, int] = {}
    lead = np.empty(len(texts), np.int64)
    for at in place:
        lead[at] = found.setdefault(texts[at], at)
    strings = np.fromiter(found.values(), np.int64, len(found))
    strings = strings[np.argsort(keys[strings], kind="stable")]
    own = keys[strings]
    fresh = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
    n_own = np.diff(np.append(np.flatnonzero(fresh), len(own)))
    several = np.repeat(n_own > 1, n_own)
    strings, fresh = strings[several], fresh[several]
    size = np.cumsum([len(texts[i]) for i in strings.tolist()])
    ends = np.append(np.flatnonzero(fresh)[1:], len(strings))
    out, first = np.zeros(len(texts), U64), 0
    while first < len(strings):
        done = size[first - 1] if first else 0
        last = max(int(np.searchsorted(size, done + PARSE_BYTES, "right")), first + 1)
        last = int(ends[np.searchsorted(ends, last)])
        part = strings[first:last]
        out[part] = _judged([texts[i] for i in part.tolist()], rank[part], starts[part])
        first = last
    same_place = (ids == ids[lead]) & (starts == starts[lead])
    full = U64((1 << 64) - 1) >> (U64(64) - np.minimum(counts, 64).astype(U64))
    return np.where(same_place, out[lead], full)


def _judged(texts: list[bytes], rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Masks of different strings, by their suffix order."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    order, group = window_groups(np.frombuffer(b"".join(texts), np.uint8), offsets)
    out = np.zeros(len(texts), U64)
    if len(order):
        string = np.searchsorted(offsets, order, "right") - 1
        inside = order - offsets[string]
        doc, pos = rank[string], starts[string] + inside
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least_doc = np.minimum.reduceat(doc, first)[group]
        least_pos = np.minimum.reduceat(np.where(doc == least_doc, pos, np.iinfo(np.int64).max), first)[group]
        later = (doc > least_doc) | (pos > least_pos)
        np.bitwise_or.at(out, string[later], U64(1) << inside[later].astype(U64))
    return out


KIND = Kind(WINDOW, GRAM, byte_symbols, judged, False)


def byte_masks(docs: DataFrame, kind: Kind = KIND) -> tuple[Blocks, dict[str, DataFrame]]:
    blocks = Blocks(docs, "suffix_blocks")
    return blocks, covered_symbols(blocks, kind)


def running(marks: np.ndarray) -> np.ndarray:
    """Marks before each place, and all of them."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, dtype=np.int32, out=out[1:])
    return out


def op10(docs: DataFrame, kind: Kind = KIND) -> DataFrame:
    blocks, replies = byte_masks(docs.select("doc_id", "text"), kind)
    n_buckets = blocks.n_buckets

    def finish(rows: pa.RecordBatch, have: dict[str, bytes]) -> pa.RecordBatch:
        block = Block(rows, kind)
        gone, off = covered(block, have, n_buckets), block.text_offsets
        before = running(gone)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        at_start = off[:-1][off[:-1] < off[1:]]
        begins[at_start] = gone[at_start]
        runs = running(begins)
        kept = block.data[~gone].tobytes()
        ends = (off - before[off]).tolist()
        digests = [hashlib.sha256(kept[a:z]).hexdigest() for a, z in zip(ends[:-1], ends[1:], strict=True)]
        columns = [pa.array(x, pa.int64()) for x in (np.diff(off), np.diff(before[off]), np.diff(runs[off]))]
        return pa.RecordBatch.from_arrays([rows.column(0), *columns, pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return blocks.finished(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", replies)
