"""Assignment of roots to buckets: bin packing and number partitioning.

The roots of a cover are few (each is near the budget or a leaf of a small tree), so the greedy passes run on the driver, on
at most `MOST_ROOTS` collected rows; a larger cover is refused, since a larger budget gives fewer roots.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROOTS = 2_000_000

Roots = list[tuple[str, int]]


def first_fit(roots: Roots, budget: int) -> list[int]:
    """Bins by decreasing size, each root into the first bin with room.  A tournament tree over the room of bins finds it."""
    size = 1
    while size < max(1, len(roots)):
        size *= 2
    room = [budget] * (2 * size)
    out = []
    for _, n in roots:
        node = 1
        if n > budget:
            # too large for any bin: the first empty one, alone
            n_need = budget
        else:
            n_need = n
        while node < size:
            node = 2 * node if room[2 * node] >= n_need else 2 * node + 1
        out.append(node - size)
        room[node] -= n
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return out


def best_fit(roots: Roots, budget: int) -> list[int]:
    """Each root into the fullest bin with room for it, else a new one."""
    bins: list[tuple[int, int]] = []
    out = []
    for _, n in roots:
        at = bisect_left(bins, (n, -1))
        room, number = bins.pop(at) if at < len(bins) else (budget, len(bins))
        insort(bins, (room - n, number))
        out.append(number)
    return out


def worst_fit(roots: Roots, budget: int) -> list[int]:
    """Each root into the emptiest bin if it has room, else a new one."""
    bins: list[tuple[int, int]] = [(0, 0)] if roots else []
    out = []
    for _, n in roots:
        load, number = bins[0]
        if load + n <= budget or not load:
            heapq.heapreplace(bins, (load + n, number))
        else:
            number = len(bins)
            heapq.heappush(bins, (n, number))
        out.append(number)
    return out


def least_loaded(roots: Roots, buckets: int) -> list[int]:
    """Each root into the least loaded of a fixed number of buckets."""
    heap = [(0, b) for b in range(buckets)]
    out = []
    for _, n in roots:
        load, bucket = heap[0]
        heapq.heapreplace(heap, (load + n, bucket))
        out.append(bucket)
    return out


def hybrid(roots: Roots, budget: int, partitions: int) -> list[int]:
    """As many buckets as best fit needs, rounded up to a multiple of `partitions`, then balanced."""
    most = max(best_fit(roots, budget), default=-1)
    return least_loaded(roots, (most // partitions + 1) * partitions) if most >= 0 else []


METHODS = {
    "ff": lambda roots, budget, partitions: first_fit(roots, budget),
    "bf": lambda roots, budget, partitions: best_fit(roots, budget),
    "wf": lambda roots, budget, partitions: worst_fit(roots, budget),
    "hg": lambda roots, budget, partitions: least_loaded(roots, partitions),
    "bfhg": hybrid,
}


def assigned(cover: DataFrame, method: str, budget: int, partitions: int) -> DataFrame:
    """`prefix, cnt, bucket` for each root, largest first and by prefix for equal sizes."""
    if method.lower() not in METHODS:
        raise ValueError(f"unknown grouping method {method!r}")
    rows = cover.orderBy(F.desc("cnt"), "prefix").limit(MOST_ROOTS + 1).collect()
    if len(rows) > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} roots; raise the budget")
    roots = [(r["prefix"], r["cnt"]) for r in rows]
    buckets = METHODS[method.lower()](roots, budget, partitions)
    data = [(p, n, b) for (p, n), b in zip(roots, buckets, strict=True)]
    return cover.sparkSession.createDataFrame(data, "prefix string, cnt long, bucket long")


def iterations(assignment: DataFrame, partitions: int) -> DataFrame:
    """`prefix, bucket, iteration, part`: rounds of `partitions` buckets, one for each task."""
    return assignment.select("prefix", "bucket", F.expr(f"bucket div {partitions}").alias("iteration"), (F.col("bucket") % partitions).alias("part"))


def review(assignment: DataFrame, partitions: int) -> DataFrame:
    """`iteration, mean_load, sigma`: whole mean and population deviation of the bucket loads of each round.  Buckets after the
    last used one do not count in the deviation, though it is divided by `partitions`."""
    spark = assignment.sparkSession
    used = assignment.groupBy("bucket").agg(F.sum("cnt").alias("load"))
    most = used.agg(F.max("bucket").alias("most"))
    every = spark.range(1).crossJoin(most).where("most IS NOT NULL").select(F.explode(F.expr("sequence(0L, most)")).alias("bucket"))
    loads = every.join(used, "bucket", "left").select(F.expr(f"bucket div {partitions}").alias("iteration"), F.coalesce("load", F.lit(0)).alias("load"))
    means = loads.groupBy("iteration").agg(F.expr(f"sum(load) div {partitions}").alias("mean_load"))
    spread = loads.join(F.broadcast(means), "iteration").groupBy("iteration", "mean_load").agg(F.sqrt(F.sum(F.pow(F.col("load") - F.col("mean_load"), 2)) / partitions).alias("sigma"))
    return spread.select("iteration", "mean_load", "sigma")
