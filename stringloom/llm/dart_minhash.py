"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Signature.  An element of weight w owns the region [0, w) of a weight axis, cut into cells [0,1), [1,2), [2,4), ...  Darts
fall on cell x rank plane as a Poisson process that depends on the element's hash only; a dart has a coordinate of the
signature, and counts if its weight lies in the element's region.  Each coordinate keeps its dart of least rank.  Two
signatures agree in a coordinate with the probability of the weighted Jaccard similarity.  Only darts up to the rank where
all coordinates are hit are thrown, so the work is a few darts for each coordinate, not coordinates times elements.

Joining.  Documents with equal shingle sets are one class.  Classes that share a band of the signature meet in a bucket, and
classes that buckets join, directly or over others, are a family.  Two classes of a family are compared exactly, on the
shingles of their texts, if they share a band and are not yet joined; a link is a Jaccard similarity of the five-word shingle
sets of at least 0.8.  A family within bounds is compared in one task, a larger one in rounds of leaders over parts of it; both
follow the one rule, and only links that join something leave a task.

Bound of the search: two classes of similarity 0.8 share no band in 3 of a million cases, fewer above; such a pair is only
joined over others.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a text of one to four words has one shingle; null and wordless texts link with
nothing; equal texts are linked; rows that share an id are told apart by their text, so rows equal in id (null included) and text are one
document: if it is its group's head, all of them are kept; further columns are kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.graph import components
from stringloom.llm.shared import bounded_batches, shuffle_partitions, written
from stringloom.llm.textkit import BASE_1, BASE_2, U64, WHITE, gram_hashes, groups_of_bytes, mixed, span_hashes, text_buffer, tidy, word_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Classes and shingles of a family that is compared in one task, shingles of a task's families or of a part of a larger family,
#: and shingles of the leaders of a round.
FAMILY, FAMILY_SHINGLES, SHARD_SHINGLES, LEAD_SHINGLES = 1024, 1_000_000, 500_000, 100_000
DART, CELL, SPOT, RANK = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, distinct and in order within a text; n + 1 offsets)."""
    raw, off = text_buffer(texts)
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    for a, z in groups_of_bytes(off, 1 << 19):
        data, local = raw[off[a] : off[z]], off[a : z + 1] - off[a]
        starts, ends, words = word_spans(data, local, WHITE)
        own = word_hashes(data, starts, ends)
        grams = gram_hashes(own, SHINGLE)
        doc = np.repeat(np.arange(z - a), np.diff(words))
        inside = np.flatnonzero(doc[: len(grams)] == doc[SHINGLE - 1 : SHINGLE - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
        n = np.diff(words)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        value = np.concatenate([grams[inside], span_hashes(own, words[:-1][short], n[short], BASE_1)[0]])
        owner = np.concatenate([doc[inside], short])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        parts.append(value[fresh])
        sizes.append(np.bincount(owner[fresh], minlength=z - a))
    flat = np.concatenate(parts) if parts else np.zeros(0, U64)
    return flat, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) if sizes else np.zeros(1, np.int64)


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1) / (1 << 53)


def signatures(elements: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """Signatures (n, k) of weighted sets; rows of sets without weight are zero."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    # each element once for every cell its region reaches into
    cells = np.where(weights > 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))), weights > 0).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, np.exp2(cell - 1), 0)
    width = np.where(cell > 0, low, 1)
    seed = mixed(elements[which] + (cell.astype(U64) + U64(1)) * CELL)
    owner, weight = owner[which], weights[which]
    mass = np.bincount(owner, width, n)
    limit = np.full(n, k * (np.log(k) + 2)) / np.maximum(mass, 1e-9)
    partial = weight < low + width
    rank, thrown = np.zeros(len(seed)), np.zeros(len(seed), U64)
    least = np.full(n * k, np.inf)
    out = np.zeros(n * k, U64)
    live = np.arange(len(seed))
    filled = mass == 0
    while len(live):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active = live
        while len(active):
            dart = mixed(seed[active] + (thrown[active] + U64(1)) * DART)
            ahead = rank[active] - np.log(unit(mixed(dart + RANK))) / width[active]
            ok = np.flatnonzero(ahead <= limit[owner[active]])
            active, dart, ahead = active[ok], dart[ok], ahead[ok]
            rank[active] = ahead
            thrown[active] += U64(1)
            place = owner[active] * k + (dart % U64(k)).astype(np.int64)
            if (cut := partial[active]).any():
                # a dart beyond the element's weight misses
                inside = ~cut
                inside[cut] = low[active[cut]] + width[active[cut]] * unit(mixed(dart[cut] + SPOT)) <= weight[active[cut]]
                found.append((place[inside], ahead[inside], dart[inside]))
            else:
                found.append((place, ahead, dart))
        for place, ahead, _ in found:
            np.minimum.at(least, place, ahead)
        for place, ahead, dart in found:
            best = ahead == least[place]
            out[place[best]] = dart[best]
        filled |= np.isfinite(least.reshape(n, k)).all(axis=1)
        limit *= 1.5
        live = live[~filled[owner[live]]]
    return out.reshape(n, k)


def features(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash, set_1, set_2, n_shingles, signature` for each row; the signature is null without shingles."""
    rows = bounded_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = text_buffer(batch.column(1))[1]
            for a, z in groups_of_bytes(off, 1 << 19):
                part = batch.slice(a, z - a)
                flat, at = shingles(part.column(1))
                n = np.diff(at)
                sums = [np.concatenate([[U64(0)], np.cumsum(mixed(flat * base), dtype=U64)]) for base in (BASE_1, BASE_2)]
                sets = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                short = (signatures(flat, at) >> U64(32)).astype(np.uint32)
                signature = pa.array([s.tobytes() if c else None for s, c in zip(short, n, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sets[0]), pa.array(sets[1]), pa.array(n, pa.int64()), signature], names=["doc_id", "text_hash", "set_1", "set_2", "n_shingles", "signature"]
                )

    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, set_1 long, set_2 long, n_shingles long, signature binary")


def band_keys(signatures: list[bytes]) -> np.ndarray:
    """(signatures, bands): the bucket of each band."""
    s = np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, BANDS, ROWS).astype(U64)
    h = np.zeros(s.shape[:2], U64) + np.arange(BANDS, dtype=U64)
    for i in range(ROWS):
        h = mixed(h * DART + s[:, :, i])
    return h


def _bands(classes: DataFrame) -> DataFrame:
    """`bucket, node` for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = band_keys(batch.column(1).to_pylist())
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(node)], names=["bucket", "node"])

    return classes.select("node", "signature").mapInArrow(tidy(run), "bucket long, node long")


def _families(bands: DataFrame) -> DataFrame:
    """`node, family` of the classes that buckets join, directly or over others.

    The least class of a bucket is its hub.  A class joins all its hubs with each other, so components are sought among hubs
    only: the classes of a small family all have the same one and give no link at all."""
    shared = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where(F.col("hub") != F.col("most")).select("bucket", "hub")
    tops = written(bands.join(shared, "bucket").groupBy("node").agg(F.min("hub").alias("low"), F.collect_set("hub").alias("hubs")), "near-hubs")
    several = tops.where(F.size("hubs") > 1).select(F.col("low").alias("a"), F.explode("hubs").alias("b"))
    joined = components(several).withColumnRenamed("node", "low")
    return tops.select("node", "low").join(joined, "low", "left").select("node", F.coalesce("component", "low").alias("family"))


def _links_of_unit(label: np.ndarray, n_first: int, bands: np.ndarray, sets: list[np.ndarray], size: int) -> list[tuple[int, int]]:
    """Links between labels that join the classes of a unit: each of the first `n_first` classes is compared exactly with the
    later ones that share a band with it and are not yet joined with it; `sets` are numbers below `size`."""
    n = np.array([len(x) for x in sets])
    now = label.copy()
    marked = np.zeros(size, bool)
    for i in range(n_first):
        later = slice(i + 1, None)
        j = np.flatnonzero((now[later] != now[i]) & (np.minimum(n[later], n[i]) >= SIMILARITY * np.maximum(n[later], n[i]))) + i + 1
        j = j[(bands[j] == bands[i]).any(axis=1)]
        if not len(j):
            continue
        marked[sets[i]] = True
        shared = np.array([int(marked[sets[x]].sum()) for x in j.tolist()])
        marked[sets[i]] = False
        for x in j[shared >= SIMILARITY * (n[i] + n[j] - shared) - 1e-9].tolist():
            if now[x] != now[i]:
                now[now == now[x]] = now[i]
    # each label with the least one that it was joined with
    _, own = np.unique(now, return_inverse=True)
    least = np.full(len(now), np.iinfo(np.int64).max)
    np.minimum.at(least, own, label)
    return sorted({(a, b) for a, b in zip(least[own].tolist(), label.tolist(), strict=True) if a != b})


def _compared(group: pa.Table, n_first: int | None = None) -> list[tuple[int, int]]:
    """Links of one unit; without `n_first` each class is compared with all later ones."""
    flat, off = shingles(group.column("text"))
    names, number = np.unique(flat, return_inverse=True)
    label = group.column("label").to_numpy()
    return _links_of_unit(label, len(label) - 1 if n_first is None else n_first, band_keys(group.column("signature").to_pylist()), np.split(number, off[1:-1]), len(names))


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _links_of_shard(shard: pa.Table) -> pa.Table:
    """Links inside the families of a shard, each compared as a whole."""
    shard = shard.sort_by([("family", "ascending"), ("label", "ascending")])
    family = shard.column("family").to_numpy()
    cuts = np.flatnonzero(np.append(True, family[1:] != family[:-1])).tolist()
    return _link_table([link for a, z in zip(cuts, [*cuts[1:], len(family)], strict=True) for link in _compared(shard.slice(a, z - a))])


def _links_of_part(part: pa.Table) -> pa.Table:
    """Links between the leaders of a large family and the classes of one part of it."""
    part = part.sort_by([("leads", "descending"), ("node", "ascending")])
    return _link_table(_compared(part, int(np.sum(part.column("leads").to_numpy(zero_copy_only=False)))))


def _links_by_leaders(members: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of families too large for a task; `members` has `family, node, n_shingles, text,
    signature`.

    A round deals a family out in parts of bounded size and compares some classes, the leaders, with all others, in every part
    at once: texts move once a round, not once for each pair of parts.  What is linked gets one label, and leaders need no
    further comparison, so a round leaves only classes beside the largest label.  Leaders are taken from these by hash, as
    many as `LEAD_SHINGLES` allows; the rounds end when each family has one label left."""
    spark, links = members.sparkSession, []
    labels = members.select("family", "node", "n_shingles", F.col("node").alias("label"))
    while True:
        loads = labels.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load"))
        main = loads.groupBy("family").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("load").alias("load"))
        draw = F.pmod(F.xxhash64("node", F.lit(len(links))), F.lit(1 << 40))
        parts = F.ceil(F.col("load") / SHARD_SHINGLES).cast("int")
        open_ = labels.join(main.where("kinds > 1"), "family").withColumns({"draw": draw, "parts": parts, "beside": F.col("label") != F.col("main")})
        open_ = written(open_.select("family", "node", "n_shingles", "label", "draw", "parts", "beside"), "near-open")
        if not open_.limit(1).count():
            break
        share = F.lit(float(LEAD_SHINGLES) * (1 << 40)) / F.sum("n_shingles")
        bounds = open_.where("beside").groupBy("family").agg(F.greatest(share, F.min("draw")).alias("bound"))
        dealt = open_.join(bounds, "family").withColumn("leads", F.col("beside") & (F.col("draw") <= F.col("bound")))
        own = dealt.select("family", "node", "label", F.lit(False).alias("leads"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int").alias("part"))
        lead = dealt.where("leads").select("family", "node", "label", "leads", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        full = own.unionByName(lead).join(members.select("node", "text", "signature"), "node")
        links.append(written(full.groupBy("family", "part").applyInArrow(_links_of_part, "a long, b long"), "near-links"))
        joined = components(links[-1]).select(F.col("node").alias("label"), "component")
        left = dealt.where("NOT leads").join(joined, "label", "left")
        labels = left.select("family", "node", "n_shingles", F.coalesce("component", "label").alias("label"))
    return reduce(DataFrame.unionByName, links, spark.createDataFrame([], "a long, b long"))


def _links(bands: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes as all links would: Jaccard similarity of the texts' shingle sets of at least 0.8 of
    two classes that share a band.  A family within the bounds is compared in one task, so each of its texts moves once."""
    sized = _families(bands).join(classes.select("node", "n_shingles", "lead"), "node")
    sizes = sized.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("load"))
    large = (F.col("n") > FAMILY) | (F.col("load") > FAMILY_SHINGLES)
    units = written(sized.join(sizes, "family").select("family", "node", "n_shingles", large.alias("large"), F.col("lead.doc_id").alias("doc_id"), F.col("lead.text_hash").alias("text_hash")), "near-units")
    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("hash"))
    # one plan at every size: a broadcast of units that happen to be few would hide what the texts cost
    found = keyed.join(units.hint("merge"), keyed.id.eqNullSafe(units.doc_id) & (keyed.hash == units.text_hash))
    texts = found.groupBy("node").agg(*(F.first(c).alias(c) for c in ("family", "n_shingles", "large", "text")))
    full = written(texts.join(classes.select("node", "signature"), "node"), "near-texts")
    total, n_large = full.agg(F.sum("n_shingles"), F.count_if("large")).first()
    shards = max(shuffle_partitions(docs.sparkSession), (total or 0) // SHARD_SHINGLES)
    whole = full.where("NOT large").select("family", F.col("node").alias("label"), "text", "signature")
    links = written(whole.groupBy(F.pmod(F.xxhash64("family"), F.lit(shards))).applyInArrow(_links_of_shard, "a long, b long"), "near-links")
    return links.unionByName(_links_by_leaders(full.where("large"))) if n_large else links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, text_hash, component_id, kept, n_shingles` for each row: `component_id` is the least id of the row's group, and
    one document of each group is kept, with all rows that repeat its id and text."""
    rows = written(features(docs), "near-features")
    lead = F.struct("doc_id", "text_hash")
    classes = rows.where("n_shingles > 0").groupBy("set_1", "set_2").agg(F.min(lead).alias("lead"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # numbered, not hashed: no two classes share a number; the numbers hold once they are written
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    labels = components(_links(written(_bands(classes), "near-bands"), classes, docs))
    # the least id of each component, by its nodes' least ids
    groups = classes.select("node", "set_1", "set_2", "lead").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = groups.groupBy("component").agg(F.min("lead").alias("head"))
    groups = groups.join(heads, "component").select("set_1", "set_2", "head")
    plain = rows.select("doc_id", "text_hash", "set_1", "set_2", "n_shingles")
    linked = plain.where("n_shingles > 0").join(groups, ["set_1", "set_2"]).select("doc_id", "text_hash", "n_shingles", "head")
    alone = plain.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", lead.alias("head"))
    return linked.unionByName(alone).select("doc_id", "text_hash", F.col("head.doc_id").alias("component_id"), lead.eqNullSafe(F.col("head")).alias("kept"), "n_shingles")


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "component_id", "kept", "n_shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document for each group of near duplicates, the one of least id, in all rows that repeat its id and text;
    columns as they were."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    id_, hash_ = (max(docs.columns, key=len) + x for x in ("_id", "_hash"))
    gone = gone.select(F.col("_id").alias(id_), F.col("_hash").alias(hash_))
    return docs.join(gone, docs.doc_id.eqNullSafe(gone[id_]) & (F.xxhash64(docs.text) == gone[hash_]), "left_anti")
