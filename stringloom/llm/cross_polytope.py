"""Near-duplicate embeddings by cross-polytope hashing.

Hash.  A vector is rotated three times by random signs and a fast Hadamard transform; the coordinate of greatest magnitude
and its sign name the nearest corner of the cross-polytope.  `CORNERS` independent corners make a table's key, and `TABLES`
tables are used.  Multiprobe: besides its own bucket, a vector is looked up in the buckets where one corner is replaced by
its second best.

Pairs.  Vectors that are equal in all components are one class first, so copies never meet.  Buckets with one class are
dropped before any vector moves.  In a bucket the own members are compared with all members by a matrix product in double
precision, block by block; a pair with cosine >= 0.95 is a link.  A pair that meets in several buckets is counted in the first
of them only, which both sides can tell from the vectors alone, so links are counted without being listed: a bucket gives one
row of partial counts for each member and one row of its local component.

Cost: counting the links of n different vectors that are all near each other takes n * n comparisons, as the count itself says;
they are dealt out as pairs of parts, in each of which a vector moves once, so tasks stay of one size whatever n is.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with nothing; so do vectors
of another length than the one compared with (lengths are kept apart); rows that share a `vec_id` are told apart by their
vectors, and equal rows are linked copies; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.graph import components
from stringloom.llm.shared import shuffle_partitions, written
from stringloom.llm.textkit import U64, mixed

COSINE = 0.95
TABLES = 24
CORNERS = 4
ROTATIONS = 3
SEED = 20_240_229
TILE = 1024
#: Rows of a bucket compared as plain pairs, of a part of a bucket, and of a shard.
SMALL, PART, SHARD_ROWS = 48, 4096, 40_000


class Hasher:
    """Keys of vectors of one length."""

    def __init__(self, length: int, tables: int = TABLES, corners: int = CORNERS):
        self.width = 1 << max(0, length - 1).bit_length()
        self.tables, self.corners = tables, corners
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables * corners, ROTATIONS, self.width))

    def rotated(self, x: np.ndarray, which: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for signs in self.signs[which]:
            y *= signs
            half = 1
            while half < self.width:
                z = y.reshape(len(x), -1, 2, half)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(x), -1)
                half *= 2
        return y

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + corners): the own key, then the key of each probe."""
        out = np.zeros((len(x), self.tables, 1 + self.corners), U64)
        row = np.arange(len(x))
        for t in range(self.tables):
            best = np.zeros((self.corners, len(x)), np.int64)
            second = np.zeros((self.corners, len(x)), np.int64)
            for c in range(self.corners):
                y = self.rotated(x, t * self.corners + c)
                size = np.abs(y)
                for corner in (best, second):
                    at = size.argmax(axis=1)
                    corner[c] = 2 * at + (y[row, at] < 0)
                    size[row, at] = -1
            for probe in range(1 + self.corners):
                code = np.full(len(x), U64(t + 1), U64)
                for c in range(self.corners):
                    code = mixed(code * U64(0x9E3779B97F4A7C15) + (second if probe == c + 1 else best)[c].astype(U64))
                out[:, t, probe] = code
        return out


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column of doubles, all of one length, each divided by the power of two next to its greatest magnitude: that
    changes no cosine, and no square of a large or small one is lost."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _classes(rows: DataFrame) -> DataFrame:
    """`node, vector array<double>, copies, lead` for each distinct usable vector."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    usable = rows.select("vec_id", vector.alias("vector")).where(F.col("vector").isNotNull() & finite)
    # -0.0 is 0.0
    usable = usable.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    return usable.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lead")).withColumn("node", F.xxhash64("vector"))


def _keyed(classes: DataFrame) -> DataFrame:
    """`bucket, node, own` for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 1):
                x = vectors_of(batch.column(1))
                for a in range(0, len(x), 4096):
                    keys = hasher(x.shape[1]).keys(x[a : a + 4096]) ^ mixed(np.full(1, x.shape[1], U64))
                    n, t, p = keys.shape
                    own = np.tile(np.arange(p) == 0, n * t)
                    node = np.repeat(batch.column(0).to_numpy()[a : a + 4096], t * p)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), pa.array(own)], names=["bucket", "node", "own"])

    return classes.select("node", "vector").mapInArrow(run, "bucket long, node long, own boolean")


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(batch.column(at).offsets.to_numpy())
    for length in np.unique(lengths).tolist():
        yield batch if (lengths == length).all() else batch.filter(pa.array(lengths == length))


_hashers: dict[int, Hasher] = {}


def hasher(length: int) -> Hasher:
    if length not in _hashers:
        _hashers[length] = Hasher(length)
    return _hashers[length]


def _pairs_of_groups(first: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j inside groups of rows, at most about `most` at once."""
    done = 0
    pairs = np.cumsum(size * (size - 1) // 2)
    while done < len(first):
        before = pairs[done - 1] if done else 0
        last = max(done + 1, int(np.searchsorted(pairs, before + most, "right")))
        f, n = first[done:last], size[done:last]
        row = np.repeat(f, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        after = np.repeat(f + n, n) - row - 1
        i = np.repeat(row, after)
        yield i, i + 1 + (np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after))
        done = last


def _candidates(first: np.ndarray, size: np.ndarray, unit: np.ndarray, index: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one unit that may be links: all pairs of small units, those of a matrix product for large ones."""
    small = size <= SMALL
    for i, j in _pairs_of_groups(first[small], size[small]):
        ok = own[i] | own[j]
        yield i[ok], j[ok]
    for f, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
        for a in range(f, f + n, TILE):
            za = min(f + n, a + TILE)
            for b in range(a, f + n, TILE):
                zb = min(f + n, b + TILE)
                i, j = np.nonzero(unit[index[a:za]] @ unit[index[b:zb]].T >= COSINE - 1e-9)
                i, j = i + a, j + b
                ok = (i < j) & (own[i] | own[j])
                yield i[ok], j[ok]


def _linked(shard: pa.Table) -> pa.Table:
    """Links of the units of a shard: `node, links` counted here and `low`, the least node it is linked with in this shard."""
    shard = shard.sort_by([("bucket", "ascending"), ("low_part", "ascending"), ("high_part", "ascending"), ("node", "ascending")])
    bucket, node, own, low, high, part, copies = (shard.column(c).to_numpy() for c in ("bucket", "node", "own", "low_part", "high_part", "part", "copies"))
    nodes, at, index = np.unique(node, return_index=True, return_inverse=True)
    lists = shard.column("vector").combine_chunks().take(pa.array(at))
    lengths = np.diff(lists.offsets.to_numpy())[index]
    fresh = np.ones(len(node), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    count, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    copies_of = copies[at]
    for length in np.unique(lengths).tolist():
        of = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == length)
        x = np.zeros((len(nodes), length))
        x[of] = vectors_of(lists.take(pa.array(of)))
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        size[size == 0] = 1
        # keys are only needed for the ends of links
        keys, known = np.zeros((len(nodes), TABLES, 1 + CORNERS), U64), np.zeros(len(nodes), bool)
        first = np.flatnonzero(fresh & (lengths == length))
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(node)))[np.searchsorted(np.flatnonzero(fresh), first)]
        for i, j in _candidates(first, sizes, x / size[:, None], index, own):
            # in a unit of two parts only pairs across them
            ok = (low[i] == high[i]) | (part[i] != part[j])
            i, j = i[ok], j[ok]
            for a in range(0, len(i), 1 << 15):
                r, u, v = i[a : a + (1 << 15)], index[i[a : a + (1 << 15)]], index[j[a : a + (1 << 15)]]
                ok = np.einsum("ij,ij->i", x[u], x[v]) / (size[u] * size[v]) >= COSINE
                r, u, v = r[ok], u[ok], v[ok]
                fresh_ends = np.unique(np.concatenate([u, v]))
                fresh_ends = fresh_ends[~known[fresh_ends]]
                if len(fresh_ends):
                    keys[fresh_ends] = hasher(length).keys(x[fresh_ends]) ^ mixed(np.full(1, length, U64))
                    known[fresh_ends] = True
                ok = _first_meeting(keys[u], keys[v]) == bucket[r].view(U64)
                u, v = u[ok], v[ok]
                np.add.at(count, u, copies_of[v])
                np.add.at(count, v, copies_of[u])
                while (label[u] != label[v]).any():
                    least = np.minimum(label[u], label[v])
                    for side in (u, v):
                        np.minimum.at(label, label[side], least)
                        np.minimum.at(label, side, least)
                    label = label[label]
    while (label[label] != label).any():
        label = label[label]
    some = count > 0
    return pa.table({"node": pa.array(nodes[some], pa.int64()), "links": pa.array(count[some], pa.int64()), "low": pa.array(nodes[label][some], pa.int64())})


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket in which a pair is counted: in the first table where one's own key is among the other's, the first such key
    (a's own before b's own, in order of the keys so that it is the same from either side)."""
    of_a = (a[:, :, :1] == b).any(axis=2)
    of_b = (b[:, :, :1] == a).any(axis=2)
    table = (of_a | of_b).argmax(axis=1)
    row = np.arange(len(a))
    key_a, key_b = a[row, table, 0], b[row, table, 0]
    hit_a, hit_b = of_a[row, table], of_b[row, table]
    top = U64((1 << 64) - 1)
    return np.minimum(np.where(hit_a, key_a, top), np.where(hit_b, key_b, top))


def near_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, `node, links` counted with copies, `a, b` edges that span the components)."""
    classes = written(_classes(rows), "vector-classes")
    keyed = written(_keyed(classes), "vector-keys")
    # a bucket matters if it has an own member and another class
    sizes = keyed.groupBy("bucket").agg(F.max("own").alias("any_own"), F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n"))
    useful = sizes.where(F.col("any_own") & (F.col("least") != F.col("most"))).select("bucket", "n")
    members = keyed.join(useful, "bucket").groupBy("bucket", "node", "n").agg(F.max("own").alias("own"))
    # a large bucket is dealt out as pairs of parts, so that no task compares more than two parts
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
    dealt = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"low_part": F.least("part", "other"), "high_part": F.greatest("part", "other")})
    dealt = written(dealt.drop("other", "n"), "vector-units")
    full = dealt.join(classes.select("node", "vector", "copies"), "node")
    # sized by what was dealt out, copies for the other parts included
    shards = max(shuffle_partitions(rows.sparkSession), dealt.count() // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("bucket", "low_part", "high_part"), F.lit(shards))
    found = written(full.groupBy(shard).applyInArrow(_linked, "node long, links long, low long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    return classes, links, edges


def op5(rows: DataFrame) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for each row."""
    rows = rows.select("vec_id", "embedding")
    classes, links, edges = near_vectors(rows)
    labels = components(edges)
    groups = classes.join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = groups.groupBy("component").agg(F.min("lead").alias("component_id"))
    groups = groups.join(heads, "component").select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    keyed = rows.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0)).alias("vector"))
    return keyed.join(groups, "vector", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
