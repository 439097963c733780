"""Leaf depths of texts that fit a task's memory as a whole: tasks take shares of the suffixes and read all texts.

No suffix, rank or common prefix is written or shuffled.  A task counts the first few characters of all suffixes, takes a share of
them in that order, and refines groups of suffixes that agree so far by more and more characters.  Where a group parts, its common
prefix branches, and the depth of each of its suffixes grows by one; a suffix alone is done, and so are two, which part once more.
The end of a text differs from any other end, so a whole suffix that another one begins with branches too.

Growth: texts are read once for each task, and a task holds them all; so this is for texts up to `BYTES`, and `intervals` for
any others.  How often a group is looked at depends on the branching prefixes of its suffixes; what a group has in common is skipped
by 64 bytes at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.operators.intervals import Cut, leaf_depth_long

#: UTF-8 bytes of all different texts, and characters of one of them, up to which tasks hold them: a byte for each character in a
#: worker where there are no more than 255 different ones, else two or four.
BYTES = 200 << 20
LONGEST = 1 << 20
#: Suffixes of a task, and of those that are refined together.
SHARE = 14 << 20
BUCKET = 1 << 20
#: Characters beyond which many suffixes that begin alike are refined together all the same.
AGAIN = 64
#: Characters and rows that are handled at once.
TEXT = 2 << 20
ROWS = 1 << 18
#: Counted first characters: as many as give no more different ones than this.
COUNTED = 1 << 24
CHUNK = 1 << 20
#: Rounds without a look at what a group has in common, bytes of such a look, and looks at once.
EAGER = 3
LOOK = 64
LOOKS = 1 << 14
#: Rows and bytes of an Arrow batch at most: texts can be long, and a batch is held by the JVM and the Python worker at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


class Texts:
    """Texts one behind the other, as codes from 1 in order of code points, each with 0, its end, behind it."""

    def __init__(self, batches: Iterator[pa.RecordBatch], size: int):
        self.codes, self.starts, self.ids, self.times = np.zeros(size, np.uint8), [], [], []
        seen, self.size = np.zeros(0x110000, np.uint32), 0
        points = [0]
        for whole in batches:
            lengths = pc.utf8_length(whole.column("text")).to_numpy()
            piece = np.cumsum(lengths) // TEXT
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), whole.num_rows]
            for begin, end in itertools.pairwise(cuts):
                own = "".join(whole.column("text").slice(begin, end - begin).to_pylist())
                flat = np.frombuffer(own.encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = seen[flat]
                if not codes.all():
                    new = np.unique(flat[codes == 0])
                    seen[new] = np.arange(len(points), len(points) + len(new))
                    points.extend(new.tolist())
                    codes = seen[flat]
                    wide = np.uint8 if len(points) <= 1 << 8 else np.uint16 if len(points) <= 1 << 16 else np.uint32
                    self.codes = self.codes.astype(wide, copy=False)
                at = 0
                for n in lengths[begin:end].tolist():
                    self.codes[self.size : self.size + n] = codes[at : at + n]
                    self.starts.append(self.size)
                    self.size, at = self.size + n + 1, at + n
            ids = whole.column("ids")
            self.times.append(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            # copied, since a part of a batch holds all of it
            ids = ids.flatten().field(0)
            self.ids.append(ids.take(pa.array(np.arange(len(ids)))))
        # the order of texts may differ between tasks, that of codes must not
        rank = np.zeros(len(points), self.codes.dtype)
        rank[1:][np.argsort(points[1:])] = np.arange(1, len(points))
        for i in range(0, self.size, CHUNK):
            self.codes[i : i + CHUNK] = rank[self.codes[i : i + CHUNK]]
        self.kinds = len(points)
        self.starts = np.array(self.starts, np.int64)
        self.times = np.concatenate(self.times) if self.times else np.zeros(0, np.int64)
        self.first_id = np.cumsum(self.times) - self.times
        self.ids = pa.chunked_array(self.ids).combine_chunks() if self.ids else None
        # as many characters in a word of 64 bits, the first one highest
        self.bits = 8 * self.codes.itemsize
        self.codes = self.codes.byteswap(inplace=True).view(self.codes.dtype.newbyteorder(">"))
        n = self.size + 1
        self.words = np.ndarray((n,), ">u8", self.codes, strides=(self.codes.itemsize,))
        self.looks = np.ndarray((n,), f"V{LOOK}", self.codes, strides=(self.codes.itemsize,))

    def counted(self) -> int:
        return max(q for q in (1, 2, 3) if q == 1 or self.kinds**q <= COUNTED)

    def keys(self, q: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place, first q characters as one number of each suffix from there on), by chunks; ends are below `kinds ** (q - 1)`."""
        for i in range(0, self.size, CHUNK):
            n = min(CHUNK, self.size - i)
            key = self.codes[i : i + n].astype(np.int32)
            for j in range(1, q):
                key *= self.kinds
                key += self.codes[i + j : i + j + n]
            yield i, key


def _shared(key: np.ndarray, other: np.ndarray, bits: int) -> np.ndarray:
    """By which bits two words differ, and those in which the first has an end: zero where they agree, without one."""
    ones = sum(1 << i for i in range(0, 64, bits))
    low = np.uint64(ones * ((1 << bits - 1) - 1))
    ends = ~(((key & low) + low) | key | low)
    return (key ^ other) | ends


def _leading(differ: np.ndarray, bits: int, most: int) -> np.ndarray:
    """How many of the first `most` characters of a word are zero."""
    out = np.zeros(differ.shape, np.int8)
    for n in range(1, most + 1):
        shift = 64 - bits * n
        out += differ < np.uint64(1 << shift) if shift else differ == 0
    return out


def _ahead(texts: Texts, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Characters that suffixes at two places share, up to `LOOK` bytes, without ends."""
    out = np.empty(len(one), np.int64)
    per = 64 // texts.bits
    for i in range(0, len(one), LOOKS):
        a, b = (texts.looks[x[i : i + LOOKS]].view(">u8").astype(np.uint64).reshape(-1, LOOK // 8) for x in (one, two))
        differ = _shared(a, b, texts.bits)
        parted = differ != 0
        word = parted.argmax(axis=1)
        row = np.arange(len(a))
        out[i : i + LOOKS] = np.where(parted[row, word], word * per + _leading(differ[row, word], texts.bits, per), LOOK // 8 * per)
    return out


def _refined(texts: Texts, places: np.ndarray, group: np.ndarray, known: int, depth: np.ndarray, several: np.ndarray, left: np.ndarray) -> None:
    """Adds to `depth` the branching prefixes of `known` and more characters of the suffixes at `places`, in order of their `group`:
    those that agree in so many characters, with no end among them.  `several` marks suffixes of texts with copies, of `left`
    characters: such a suffix ends more than once, so it branches even if no other suffix has all of it."""
    per = 64 // texts.bits
    at, off, number = np.arange(len(places)), np.full(len(places), known, np.int64), 0
    copies = bool(several.any())
    while len(at):
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(group[1:], group[:-1], out=first[1:])
        if number > EAGER:
            common = np.full(len(at), np.iinfo(np.int64).max)
            inner = np.flatnonzero(~first)
            here = places[at] + off
            common[inner] = _ahead(texts, here[inner], here[inner - 1])
            heads = np.flatnonzero(first)
            sizes = np.diff(heads, append=len(at))
            common = np.minimum.reduceat(common, heads)
            off += np.repeat(common, sizes)
            if (common == LOOK // 8 * per).all():
                continue
        taken = (64 - int(group[-1]).bit_length()) // texts.bits
        key = texts.words[places[at] + off].astype(np.uint64)
        if taken == per:  # one group
            order = np.argsort(key)
        else:
            order = np.argsort(key >> np.uint64(64 - taken * texts.bits) | group.astype(np.uint64) << np.uint64(taken * texts.bits))
        key, at, off = key[order], at[order], off[order]
        # characters that a suffix shares with the one before it
        shared = np.full(len(at), -1, np.int8)
        shared[1:] = _leading(_shared(key[1:], key[:-1], texts.bits), texts.bits, taken)
        shared[first] = -1
        add = np.zeros(len(at), np.int32)
        for level in range(taken):
            parts = shared == level
            if not parts.any():
                continue
            heads = np.flatnonzero(shared < level)
            branches = np.logical_or.reduceat(parts, heads)
            add += np.repeat(branches, np.diff(heads, append=len(at)))
        cut = shared < taken
        heads = np.flatnonzero(cut)
        sizes = np.diff(heads, append=len(at))
        done = sizes == 1
        if copies:
            ends = heads[done]
            ends = ends[several[at[ends]]]
            after = np.append(shared[1:], np.int8(-1))[ends]
            most = np.maximum(shared[ends], after)
            add[ends] += (most < 0) | (off[ends] + most != left[at[ends]])
            pairs = sizes == 2
            two = heads[pairs]
            pairs[pairs] = ~(several[at[two]] | several[at[two + 1]])
        else:
            pairs = sizes == 2
        two = heads[pairs]
        add[two] += 1
        add[two + 1] += 1
        depth[at] += add
        more = ~(done | pairs)
        keep = np.repeat(more, sizes)
        group = np.repeat(np.arange(int(more.sum())), sizes[more])
        at, off = at[keep], off[keep] + taken
        number += 1


def _tables(texts: Texts, counts: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """For each q first characters: branching prefixes of fewer than q, and whether a suffix of fewer is none of them."""
    counts = counts.reshape((texts.kinds,) * q)
    depth, alone = np.zeros(counts.shape, np.int32), np.zeros(counts.shape, bool)
    for n in range(q):
        after = counts.sum(axis=tuple(range(n + 1, q)))
        # an end differs from any other
        branches = np.count_nonzero(after[..., 1:], axis=-1) + after[..., 0] >= 2
        for axis in range(n):
            np.moveaxis(branches, axis, 0)[0] = False
        depth += branches.reshape(branches.shape + (1,) * (q - n))
        ending = ~branches
        for axis in range(n):
            np.moveaxis(ending, axis, 0)[0] = False
        alone[(slice(None),) * n + (0,)] |= ending.reshape(ending.shape + (1,) * (q - n - 1))
    return depth.ravel(), alone.ravel()


def _parted(texts: Texts, places: np.ndarray, known: int, depth: np.ndarray, several: np.ndarray, left: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None) -> None:
    """Adds to `depth` the branching prefixes of `known` and more characters of the suffixes at `places`, all those that agree in so
    many.  They are parted by their next characters, and again where very many have the same ones."""
    q = texts.counted()
    key, ended = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
    for j in range(q):
        code = texts.codes[np.minimum(places + known + j, texts.size)]
        key = key * texts.kinds + code
        ended |= code == 0
    base, alone = tables or _tables(texts, np.bincount(key, minlength=texts.kinds**q), q)
    depth += base[key] + (alone[key] & several)
    order = np.flatnonzero(~ended)
    order = order[np.argsort(key[order], kind="stable")]
    key = key[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    begins = np.flatnonzero(first)
    heavy = np.diff(begins, append=len(key)) > 2 * BUCKET
    cut = np.append(True, (np.diff(begins // BUCKET) > 0) | heavy[1:] | heavy[:-1])[: len(begins)]
    for begin, end in itertools.pairwise([*begins[cut].tolist(), len(key)]):
        rows = order[begin:end]
        some = depth[rows]
        if end - begin > 2 * BUCKET and key[begin] == key[end - 1] and known < AGAIN:
            _parted(texts, places[rows], known + q, some, several[rows], left[rows], None)
        else:
            _refined(texts, places[rows], np.cumsum(first[begin:end]) - 1, known + q, some, several[rows], left[rows])
        depth[rows] = some


def depths_of_share(texts: Texts, share: int, shares: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, place in it, depth) of the suffixes of one of the shares, by buckets."""
    q = texts.counted()
    counts = np.zeros(texts.kinds**q, np.int64)
    for _, key in texts.keys(q):
        counts += np.bincount(key, minlength=len(counts))
    counts[: texts.kinds ** (q - 1)] = 0
    total = int(counts.sum())
    if not total:
        return
    before = np.cumsum(counts) - counts
    tables = _tables(texts, counts, q)
    # buckets of like size in order of their suffixes, dealt out to the shares in turn, since what repeats often lies together
    buckets = -(-total // (shares * BUCKET))
    dealt = before * (shares * buckets) // total
    bucket_of = np.where((dealt % shares == share) & (counts > 0), dealt // shares + 1, 0).astype(np.uint16)
    found: list[list[np.ndarray]] = [[] for _ in range(buckets + 1)]
    for i, key in texts.keys(q):
        of = bucket_of[key]
        places = np.flatnonzero(of)
        of = of[places]
        for bucket in np.flatnonzero(np.bincount(of)).tolist():
            found[bucket].append((places[of == bucket] + i).astype(np.uint32))
    lengths = np.diff(texts.starts, append=texts.size) - 1
    for bucket in range(1, buckets + 1):
        if not found[bucket]:
            continue
        here, found[bucket] = np.concatenate(found[bucket]).astype(np.int64), []
        of = np.searchsorted(texts.starts, here, "right") - 1
        at = here - texts.starts[of]
        depth = np.zeros(len(here), np.int32)
        _parted(texts, here, 0, depth, texts.times[of] > 1, lengths[of] - at, tables)
        yield of, at, depth


def _rows(texts: Texts, of: np.ndarray, at: np.ndarray, depth: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each suffix and document that has its text, at most `ROWS` at once however many those are."""
    times = texts.times[of]
    upto = np.cumsum(times)
    total = int(upto[-1]) if len(upto) else 0
    for i in range(0, total, ROWS):
        row = np.arange(i, min(i + ROWS, total))
        some = row if total == len(of) else np.searchsorted(upto, row, "right")
        ids = texts.first_id[of[some]] + row - (upto[some] - times[some])
        columns = [texts.ids.take(pa.array(ids)), pa.array(at[some], pa.int64()), pa.array(depth[some], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", "depth"])


def rows_of_share(texts: Texts, share: int, shares: int) -> Iterator[pa.RecordBatch]:
    for of, at, depth in depths_of_share(texts, share, shares):
        yield from _rows(texts, of, at, depth)


def fits(texts: DataFrame) -> tuple[bool, int, int]:
    """Whether tasks can hold all of `texts`, their characters and their number; a row on the driver.  Texts that are not UTF-8, whose
    characters only Spark counts so, are not held either."""
    sums = {"size": F.sum(F.length("text")), "bytes": F.sum(F.octet_length("text")), "longest": F.max(F.length("text")), "odd": F.count_if(~F.is_valid_utf8("text")), "n": F.count(F.lit(1))}
    found = texts.agg(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in sums.items()]).first()
    return found["bytes"] + found["n"] <= BYTES and found["longest"] <= LONGEST and not found["odd"], found["size"], found["n"]


def leaf_depths(texts: DataFrame, size: int, n: int, share: int | None = None) -> DataFrame:
    """`doc_id, pos, depth` of every suffix, from `text, ids`: `n` different texts of `size` characters, each with a list of structs
    that hold the `doc_id` of a document.  The table should be written, since each task reads it."""
    share = share or SHARE
    cores = texts.sparkSession.sparkContext.defaultParallelism
    shares = -(-size // (share * cores)) * cores if size > share else max(1, min(cores, size * 16 // share))
    room = size + n + LOOK + 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = set()

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mine.update(pc.unique(batch.column("share")).to_pylist())
                yield batch

        texts = Texts(seen(), room)
        if mine:
            if len(mine) > 1 or texts.size != size + n or len(texts.starts) != n:
                raise ValueError(f"a task for shares {sorted(mine)} has {len(texts.starts)} of {n} texts")
            yield from rows_of_share(texts, *mine, shares)

    for name, most in BATCH.items():
        # Spark has no setting for one query, and smaller batches change no result
        texts.sparkSession.conf.set(name, str(most))
    kind = texts.schema["ids"].dataType.elementType["doc_id"].dataType.simpleString()
    # the product has a task for each share, which reads all texts
    every = texts.sparkSession.range(0, shares, 1, shares).toDF("share").hint("shuffle_replicate_nl")
    return texts.coalesce(1).crossJoin(every).mapInArrow(run, f"doc_id {kind}, pos long, depth long")


def leaf_depth_any(docs: DataFrame, k: int, checkpoint: Cut) -> DataFrame:
    """`doc_id, pos, depth` of every suffix of whole strings, whatever their ids: in tasks that hold all texts where they can, else by
    the rounds of `leaf_depth_long`."""
    ids = F.collect_list(F.struct("doc_id")).alias("ids")
    texts = checkpoint(docs.where(F.length("text") > 0).groupBy("text").agg(ids))
    held, size, n = fits(texts)
    return leaf_depths(texts, size, n) if held else leaf_depth_long(docs, k, checkpoint)
