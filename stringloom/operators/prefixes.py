"""Prefix frequencies, budget-bounded prefix covers, and the strings' ends among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.functions.strings import prefix
from stringloom.operators.joins import looked_up, merged
from stringloom.sources.durable import written


def windows(suffixes: DataFrame, k: int) -> DataFrame:
    """Full windows of length k."""
    return suffixes.where(F.length("suf") >= k).select("doc_id", "pos", prefix(F.col("suf"), k).alias("prefix"))


def window_counts(suffixes: DataFrame, k: int) -> DataFrame:
    return windows(suffixes, k).groupBy("prefix").agg(F.count(F.lit(1)).alias("cnt"))


def terminal_windows(suffixes: DataFrame, k: int) -> DataFrame:
    """String ends shorter than k."""
    return suffixes.where(F.length("suf") < k).select("doc_id", "pos", F.col("suf").alias("tail"))


def prefix_freq(suffixes: DataFrame, low: int, high: int) -> DataFrame:
    """`prefix, cnt, n_term` for all prefixes of length low..high: occurrences, and suffixes that end there."""
    each = suffixes.where(F.length("suf") >= low).select("suf", F.explode(F.sequence(F.lit(low), F.least(F.length("suf"), F.lit(high)))).alias("n"))
    rows = each.select(F.expr("substring(suf, 1, n)").alias("prefix"), (F.length("suf") == F.col("n")).cast("long").alias("ends"))
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("cnt"), F.sum("ends").alias("n_term"))


def over_budget_counts(suffixes: DataFrame, budget: int, start: int = 2, step: int = 4) -> DataFrame:
    """Counts of all prefixes whose parent is over budget (or that are one character long), found in rounds of `step` more
    characters under the prefixes that are still over budget; a round reads only suffixes below those."""
    low, high = 1, start
    live, found = suffixes, None
    while True:
        counts = prefix_freq(live, low, high)
        parents = counts.where(F.col("cnt") > budget).select(F.col("prefix").alias("parent"))
        below = merged(counts.where(F.length("prefix") > low), parents, F.expr("substring(prefix, 1, length(prefix) - 1)") == F.col("parent"), "left_semi")
        # written each round: the next rounds and the result read it, and plans must not grow with the rounds
        kept = written(counts.where(F.length("prefix") == low).unionByName(below), "prefix-round")
        found = kept if found is None else found.unionByName(kept)
        targets = kept.where((F.col("cnt") > budget) & (F.length("prefix") == high) & (F.col("n_term") < F.col("cnt"))).select("prefix")
        if not targets.limit(1).count():
            return found
        live = looked_up(live.withColumn("prefix", prefix(F.col("suf"), high)), targets, "prefix", "left_semi").drop("prefix")
        low, high = high + 1, high + step


def s_prefix_cover(suffixes: DataFrame, budget: int, start: int = 2, step: int = 4) -> DataFrame:
    """`prefix, cnt` of the shallowest prefixes within budget; one over budget whose occurrences are all string ends stays."""
    counts = over_budget_counts(suffixes, budget, start, step)
    return counts.where((F.col("cnt") <= budget) | (F.col("n_term") == F.col("cnt"))).select("prefix", "cnt")


def era_prefix_counts(suffixes: DataFrame, budget: int, start: int = 2, step: int = 4) -> DataFrame:
    """`prefix, cnt` by growing windows: windows within budget are done, those over budget are counted again `step` longer."""
    k, live, found = start, suffixes, None
    while True:
        counts = written(window_counts(live, k), "window-round")
        done = counts.where(F.col("cnt") <= budget)
        found = done if found is None else found.unionByName(done)
        over = counts.where(F.col("cnt") > budget).select("prefix")
        if not over.limit(1).count():
            return found
        live = live.join(over, prefix(F.col("suf"), k) == F.col("prefix"), "left_semi")
        k += step


def targeted_recount(suffixes: DataFrame, budget: int, k: int, longer: int) -> DataFrame:
    """Counts of windows of length `longer` under the windows of length k that are over budget."""
    targets = window_counts(suffixes, k).where(F.col("cnt") > budget).select(F.col("prefix").alias("target"))
    return windows(suffixes, longer).join(targets, prefix(F.col("prefix"), k) == F.col("target"), "left_semi").groupBy("prefix").agg(F.count(F.lit(1)).alias("cnt"))


def terminal_prefixes(suffixes: DataFrame, k: int) -> DataFrame:
    return prefix_freq(suffixes, 1, k).where("n_term > 0").select("prefix", "n_term")


def collect_info(suffixes: DataFrame, k: int) -> DataFrame:
    """`prefix, cnt, terminals` of prefixes of length k and shorter ones where strings end; `terminals` is the sorted list of
    `doc:pos` that end there."""
    counts = prefix_freq(suffixes, 1, k).where((F.length("prefix") == k) | (F.col("n_term") > 0))
    ends = suffixes.where(F.length("suf") <= k).groupBy(F.col("suf").alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "pos"))).alias("ends"))
    listed = F.array_join(F.transform("ends", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["pos"].cast("string"))), ",")
    return counts.join(ends, "prefix", "left").select("prefix", "cnt", F.coalesce(listed, F.lit("")).alias("terminals"))


def trie_rollup(suffixes: DataFrame, k: int) -> DataFrame:
    """`prefix, cnt`: counts of windows of length k rolled up to all their ancestors."""
    leaves = window_counts(suffixes, k)
    each = leaves.select("cnt", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda n: F.substring(F.col("prefix"), F.lit(1), n))).alias("prefix"))
    return each.groupBy("prefix").agg(F.sum("cnt").alias("cnt"))


def cover_summary(cover: DataFrame) -> DataFrame:
    return cover.agg(
        F.count(F.lit(1)).alias("n_roots"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), F.coalesce(F.max("cnt"), F.lit(0)).alias("max_cnt"), F.coalesce(F.max(F.length("prefix")), F.lit(0)).cast("long").alias("max_len")
    )


def occurrences(suffixes: DataFrame, patterns: DataFrame) -> DataFrame:
    """`prefix, doc_id, pos, suf` of every place where a pattern of `patterns(prefix)` starts, and what else `patterns` has.

    Each suffix offers one key for each distinct pattern length.  The patterns, which should be written, are counted and broadcast
    only if they are small; the keys never are."""
    sizes = patterns.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("sizes"))
    offered = suffixes.crossJoin(F.broadcast(sizes)).select("doc_id", "pos", F.explode(F.filter("sizes", lambda n: n <= F.length("suf"))).alias("n"), "suf")
    keys = offered.select("doc_id", "pos", "suf", F.expr("substring(suf, 1, n)").alias("prefix"))
    return looked_up(keys, patterns, "prefix").select("prefix", "doc_id", "pos", "suf", *(c for c in patterns.columns if c != "prefix"))


def terminal_attach(suffixes: DataFrame, k: int, budget: int) -> DataFrame:
    """`doc_id, pos, tail, is_root`: string ends shorter than k, and whether they are roots of the cover themselves."""
    roots = s_prefix_cover(suffixes, budget).select(F.col("prefix").alias("tail"), F.lit(True).alias("is_root"))
    return terminal_windows(suffixes, k).join(roots, "tail", "left").select("doc_id", "pos", "tail", F.coalesce("is_root", F.lit(False)).alias("is_root"))
