"""Vectorised text primitives on Arrow buffers: words, hashes, spans and minimizers.

Texts stay one UTF-8 buffer for a whole batch.  Words and windows are index arrays into it, so no Python object is made for
each word.  All arithmetic on hashes is modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: The two multipliers of the SplitMix64 finaliser.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd multipliers and bases of the other hashes, from the digits of the square roots of small primes.
BASE_1, BASE_2 = U64(0x6A09E667F3BCC909), U64(0xBB67AE8584CAA73B)
STEP_A = [U64(x) for x in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED9)]
STEP_B = [U64(x) for x in (0x629A292A367CD507, 0x9159015A3070DD17, 0x152FECD8F70E5939, 0x67332667FFC00B31, 0x8EB44A8768581511, 0xDB0C2E0D64F98FA7, 0x47B5481DBEFA4FA5)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, once A-Z is lower case.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, giving freed memory back to the system at the end of a task: Python workers live on for later stages, and what
    they keep counts against the executor."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups_of_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `most` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= MIX_A
    h ^= h >> U64(27)
    h *= MIX_B
    h ^= h >> U64(31)
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, n + 1 word offsets) of the maximal runs of bytes outside `gap`; runs end with their text."""
    solid = ~gap[data]
    firsts = solid.copy()
    firsts[1:] &= ~solid[:-1]
    lasts = solid.copy()
    lasts[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    firsts[begin] = solid[begin]
    lasts[end] = solid[end]
    starts, ends = np.flatnonzero(firsts), np.flatnonzero(lasts) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        have = np.empty(size, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            done = 1
            factor = base
            while done < size:
                have[done : 2 * done] = have[:done] * factor
                factor = factor * factor
                done *= 2
        if size <= 1 << 20:
            _powers[int(base)] = have
    return have


def span_index(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into the buffer, index within the span) of every element of the spans, one span after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    return inside + np.repeat(starts, lengths), inside


def span_hashes(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, *bases: np.uint64) -> list[np.ndarray]:
    """A mixed polynomial hash for each base and span; all lengths must be positive.  Spans may overlap."""
    if not len(starts):
        return [np.zeros(0, U64) for _ in bases]
    index, inside = span_index(starts, lengths)
    values = symbols[index].astype(U64) + U64(1)
    cuts = np.cumsum(lengths) - lengths
    out = []
    for base in bases:
        out.append(mixed(np.add.reduceat(values * powers(base, int(lengths.max()))[inside], cuts) + lengths.astype(U64) * base))
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, taken in slices so that memory follows a slice and not the whole buffer."""
    out = np.empty(len(starts), U64)
    step = 1 << 17
    for i in range(0, len(starts), step):
        out[i : i + step] = span_hashes(data, starts[i : i + step], ends[i : i + step] - starts[i : i + step], BASE_1)[0]
    return out


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position on (len - k + 1 values), combined by doubling."""
    if len(symbols) < k:
        return np.zeros(0, U64)
    pieces: list[tuple[int, np.ndarray]] = [(1, symbols.astype(U64))]
    level = 0
    while 2 * pieces[-1][0] <= k:
        width, h = pieces[-1]
        joined = h[:-width] * STEP_A[level] + h[width:] * STEP_B[level]
        joined ^= joined >> U64(29)
        pieces.append((2 * width, joined))
        level += 1
    total, out = pieces[-1]
    out = out[: len(symbols) - k + 1].copy()
    for width, h in reversed(pieces[:-1]):
        if total + width <= k:
            out = (out * STEP_B[(level := level + 1) % 7]) + h[total : total + len(out)]
            out ^= out >> U64(31)
            total += width
    return mixed(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    width, m = 1, values
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(values) - w + 1], m[w - width : w - width + len(values) - w + 1])


def minimizer_runs(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: (first window start, number of windows, key).

    A window is `window` neighbouring symbols of one text (offsets bound the texts).  Its minimizer is the leftmost least
    k-gram hash in it, which depends on the window's content only; so equal windows have equal keys, wherever they are.
    At most 2**20 symbols may be passed at once."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, np.zeros(0, U64)
    grams = gram_hashes(symbols, k)
    where = np.arange(len(grams), dtype=U64)
    low = U64((1 << 21) - 1)
    least = (sliding_min((grams & ~low) | where, window - k + 1) & low).astype(np.int64)
    begins = offsets[1:-1]
    valid = np.ones(len(least), bool)
    if len(begins):
        change = np.zeros(len(least) + 1, np.int32)
        np.add.at(change, np.clip(begins - window + 1, 0, len(least)), 1)
        np.add.at(change, np.minimum(begins, len(least)), -1)
        valid = np.cumsum(change[:-1]) == 0
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    # a new text begins a new run even where the minimizer's place is the same
    begins = begins[begins < len(least)]
    fresh[begins] = valid[begins]
    starts = np.flatnonzero(fresh)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | fresh[1:]
    counts = np.flatnonzero(last) + 1 - starts
    # mixed again: least hashes are small, and keys must spread over all buckets
    return starts, counts, mixed(grams[least[starts]] + BASE_2)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Boolean mask of length n, true inside any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
