"""No table that an explode has made is broadcast: Spark's estimate takes each of its rows for the one it came from."""

import itertools
import re

import pytest

from stringloom.operators.joins import looked_up, narrowed
from stringloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
#: Queries that sent all suffixes to the driver.
QUERIES = ("leaf_depth", "leaf_lines", "parse_result_lines", "leaf_depth_relational", "validation_mismatches", "next_chunk", "order_check", "built_lines", "interior_terminals", "parse_result_lines_whole", "validation_summary", "validation_join")


def broadcast_explodes(df):
    """Broadcasts in the first plan of `df` with an explode below them, but for those of one row."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depths = [len(re.match(r"[\s:+-]*", x)[0]) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            below = list(itertools.takewhile(lambda x: "Aggregate(keys=[]," not in x, lines[i + 1 : end]))
            found += [line] * any("Generate explode" in x for x in below)
    return found


@pytest.mark.parametrize("name", QUERIES)
def test_suffixes_are_not_broadcast(spark, name):
    assert not broadcast_explodes(catalogue.QUERIES[name](spark, DATA))


def test_broadcast_of_an_explode_is_found(spark):
    many = spark.range(9).selectExpr("explode(sequence(id, id + 3)) AS id")
    assert broadcast_explodes(spark.range(9).join(many.hint("broadcast"), "id"))


@pytest.mark.parametrize(("limit", "join"), [(0, "SortMergeJoin"), (1 << 20, "BroadcastHashJoin")])
def test_looked_up(spark, limit, join):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "c")], "id long, key string")
    table = spark.createDataFrame([("a", 10), ("b", 20), ("d", 30)], "key string, value long")
    for how, want in (("inner", [(1, 10), (2, 20), (4, 10)]), ("left", [(1, 10), (2, 20), (3, None), (4, 10), (5, None)])):
        got = looked_up(rows, table, "key", how, limit)
        assert sorted((r.id, r.value) for r in got.collect()) == want
        assert join in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("limit", "want"), [(0, {(1, 1), (1, 5), (1, 9), (2, 1), (None, 1)}), (1 << 20, {(1, 5), (1, 9)})])
def test_narrowed(spark, limit, want):
    rows = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 1), (None, 1)], "doc_id long, pos long")
    places = spark.createDataFrame([(1, 4), (1, 9), (3, 1), (None, 1)], "doc_id long, pos long")
    assert {tuple(r) for r in narrowed(rows, places, limit).collect()} == want
