"""Suffix-tree nodes and leaf depths.

A prefix branches if the characters that follow it and the suffixes that end there are two or more together.  The depth of a
leaf is the number of branching prefixes of its suffix, the empty one and the suffix itself included.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.functions.strings import END
from stringloom.operators.joins import looked_up, merged
from stringloom.operators.prefixes import occurrences, over_budget_counts
from stringloom.sources.durable import written


def branching(suffixes: DataFrame) -> DataFrame:
    """`prefix, n_leaves` of all branching prefixes, by one aggregate over all prefixes of all different suffixes (short strings)."""
    times = suffixes.groupBy("suf").agg(F.count(F.lit(1)).alias("times"))
    each = times.select("suf", "times", F.explode(F.sequence(F.lit(0), F.length("suf"))).alias("n"))
    rows = each.select("times", F.expr("substring(suf, 1, n)").alias("prefix"), F.expr("substring(suf, n + 1, 1)").alias("next"))
    kinds = rows.groupBy("prefix", "next").agg(F.sum("times").alias("n"))
    nodes = kinds.groupBy("prefix").agg(F.sum("n").alias("n_leaves"), F.sum(F.when(F.col("next") == "", F.col("n")).otherwise(1)).alias("ways"))
    return nodes.where("ways >= 2").select("prefix", "n_leaves")


def internal_nodes(suffixes: DataFrame) -> DataFrame:
    return branching(suffixes).select("prefix", "n_leaves", F.length("prefix").cast("long").alias("str_len"))


def equal_suffixes(suffixes: DataFrame) -> DataFrame:
    return suffixes.groupBy("suf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def interior(suffixes: DataFrame, budget: int, start: int = 2, step: int = 4) -> tuple[DataFrame, DataFrame]:
    """(cover roots `prefix, cnt, depth, stuck`, interior prefixes `prefix, below`): `depth` counts the branching proper
    prefixes of a root and `below` those of an interior prefix with itself; a stuck root is over budget but cannot grow."""
    counts = over_budget_counts(suffixes, budget, start, step).withColumn("parent", F.expr("substring(prefix, 1, length(prefix) - 1)"))
    stuck = (F.col("cnt") > budget) & (F.col("n_term") == F.col("cnt"))
    children = counts.groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("children"))
    top = suffixes.limit(1).select(F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n_term"))
    inner = merged(counts.where((F.col("cnt") > budget) & ~stuck).select("prefix", "n_term").unionByName(top), children, "prefix", "left")
    forks = inner.select("prefix", (F.coalesce("children", F.lit(0)) + F.col("n_term") >= 2).cast("long").alias("fork"))
    ups = lambda df: df.select("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n))).alias("up"))
    above = lambda df: merged(ups(df), forks.select(F.col("prefix").alias("up"), "fork"), "up").groupBy("prefix").agg(F.sum("fork").alias("depth"))
    roots = counts.where((F.col("cnt") <= budget) | stuck).select("prefix", "cnt", stuck.alias("stuck"))
    # a root is never interior, so only its proper prefixes are found
    roots = merged(roots, above(roots), "prefix", "left").select("prefix", "cnt", F.coalesce("depth", F.lit(0)).alias("depth"), "stuck")
    inside = inner.select("prefix")
    return roots, merged(inside, above(inside), "prefix", "left").select("prefix", F.coalesce("depth", F.lit(0)).alias("below"))


def interior_terminals(suffixes: DataFrame, budget: int) -> DataFrame:
    """`doc_id, pos, depth` of suffixes that are interior prefixes."""
    _, inside = interior(suffixes, budget)
    return interior_leaves(suffixes, written(inside, "interior")).select("doc_id", "pos", "depth")


def _depths_of_root(group: pd.DataFrame) -> pd.DataFrame:
    """Leaf depths of one root's suffixes by one pass over their sorted order with a stack of common-prefix intervals."""
    size = len(group["prefix"].iat[0])
    rows = sorted(zip((s + END for s in group["suf"]), group["doc_id"], group["pos"], strict=True), key=lambda r: r[0])
    n = len(rows)
    change = [0] * (n + 1)
    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        common = -1
        if i < n:
            a, b = rows[i - 1][0][:-1], rows[i][0][:-1]
            common, most = size, min(len(a), len(b))
            while common < most and a[common] == b[common]:
                common += 1
        first = i - 1
        while stack and stack[-1][0] > common:
            _, first = stack.pop()
            change[first] += 1
            change[i] -= 1
        if i < n and (not stack or stack[-1][0] < common):
            stack.append((common, first))
    depths, now = [], group["depth"].iat[0]
    for i in range(n):
        now += change[i]
        depths.append(now)
    return pd.DataFrame({"prefix": group["prefix"].iat[0], "doc_id": [r[1] for r in rows], "pos": [r[2] for r in rows], "depth": depths})


def leaves_of_roots(suffixes: DataFrame, roots: DataFrame) -> DataFrame:
    """`prefix, doc_id, pos, depth` of the suffixes below the given roots.

    Suffixes are grouped by root, so no group is over the budget; roots whose suffixes are all equal need no group.  Where roots
    have a `bucket`, a bucket's groups go to one task."""
    placed = occurrences(suffixes, roots)
    keys = [c for c in ("bucket", "prefix") if c in roots.columns]
    kind = dict(suffixes.dtypes)["doc_id"]
    grouped = placed.where("NOT stuck").select(*keys, "depth", "doc_id", "pos", "suf").repartition(keys[0]).groupBy(*keys).applyInPandas(_depths_of_root, f"prefix string, doc_id {kind}, pos long, depth long")
    return grouped.unionByName(placed.where("stuck").select("prefix", "doc_id", "pos", (F.col("depth") + 1).alias("depth")))


def interior_leaves(suffixes: DataFrame, inside: DataFrame) -> DataFrame:
    """The same of suffixes that are interior prefixes themselves; they have no root."""
    return looked_up(suffixes.withColumn("prefix", F.col("suf")), inside, "prefix").select(F.lit(None).cast("string").alias("prefix"), "doc_id", "pos", F.col("below").alias("depth"))


def leaves(suffixes: DataFrame, budget: int) -> DataFrame:
    """`prefix, doc_id, pos, depth` of every suffix, with its root or null for suffixes that are interior prefixes."""
    roots, inside = (written(df, "interior") for df in interior(suffixes, budget))
    return leaves_of_roots(suffixes, roots).unionByName(interior_leaves(suffixes, inside))


def leaf_depth(suffixes: DataFrame, budget: int) -> DataFrame:
    return leaves(suffixes, budget).select("doc_id", "pos", "depth")


def leaf_depth_relational(suffixes: DataFrame) -> DataFrame:
    """The same by joins only, over all prefixes of all different suffixes (short strings); equal suffixes are equally deep."""
    ups = suffixes.select("suf").distinct().select("suf", F.explode(F.transform(F.sequence(F.lit(0), F.length("suf")), lambda n: F.substring(F.col("suf"), F.lit(1), n))).alias("prefix"))
    hits = merged(ups, branching(suffixes).select("prefix"), "prefix").groupBy("suf").agg(F.count(F.lit(1)).alias("depth"))
    return merged(suffixes, hits, "suf", "left").select("doc_id", "pos", F.coalesce("depth", F.lit(0)).alias("depth"))


#: Names of the result files.
ROOT_FILE, INTERIOR_FILE = "subtreeForRoot_", "MainTrieRes"


def lines_of(leaves: DataFrame) -> DataFrame:
    """`file, line`: the result lines `depth doc:pos` and the file of their root, or of all suffixes without one."""
    codes = F.array_join(F.transform(F.split("prefix", ""), lambda c: F.ascii(c).cast("string")), "_")
    file = F.coalesce(F.concat(F.lit(ROOT_FILE), codes, F.lit("_")), F.lit(INTERIOR_FILE))
    line = F.concat(F.col("depth").cast("string"), F.lit(" "), F.col("doc_id").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    return leaves.select(file.alias("file"), line.alias("line"))


def leaf_lines(suffixes: DataFrame, budget: int) -> DataFrame:
    """The result lines of every suffix."""
    return lines_of(leaves(suffixes, budget))
