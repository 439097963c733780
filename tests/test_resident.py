"""Leaf depths by tasks that hold all texts, against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from stringloom.operators import intervals, resident
from stringloom.sources.durable import written
from test_suffix_index import DEMO, brute_depths, frame, got_depths

CUT = lambda df: written(df, "ranks")


def held(docs, monkeypatch, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(resident, name, value)
    monkeypatch.setattr(resident, "leaf_depth_long", None)
    return resident.leaf_depth_any(docs, 4, CUT)


def by_row(df):
    return Counter(map(tuple, df.collect()))


def wanted(ids, rows):
    brute = brute_depths({str(i): t or "" for i, t in enumerate(rows)})
    return Counter((ids[int(d)], at, depth) for (d, at), depth in brute.items())


def test_edges(spark, monkeypatch):
    for texts in ({"0": None}, {"0": ""}, {"0": "x"}, {"a": "aaaa"}, {"a": "", "b": "zz"}, {"a": "ab", "b": "cab", "c": "abx"}, DEMO, {"a": "abab", "b": "abab"}):
        assert got_depths(held(frame(spark, texts), monkeypatch)) == brute_depths({d: t for d, t in texts.items() if t})


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(spark, monkeypatch, seed):
    rng = random.Random(seed)
    few = ("a", "ab", "abñ", "abcd\U0001d11e", "\x00a", "a一")[seed]
    rows = ["".join(rng.choices(few, k=rng.randint(0, 60))) for _ in range(12)]
    # copies, near copies, and texts that end alike; ids are null, repeated, or both
    rows += [r for i, r in enumerate(rows) for _ in range(i % 3)] + [rows[0] + "b", "b" + rows[0], None, "", few * 50, few * 50 + few[0], "b" + few * 50]
    ids = [None if i % 4 == 3 else i // 2 for i in range(len(rows))]
    want = wanted(ids, rows)
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string")
    assert by_row(held(docs, monkeypatch, SHARE=(64, 1 << 20)[seed % 2])) == want
    # the same in this process, where all sizes are small
    for name, value in {"BUCKET": 16, "TEXT": 70, "ROWS": 5, "CHUNK": 7, "EAGER": seed % 3, "COUNTED": (2, 30, 300)[seed % 3]}.items():
        monkeypatch.setattr(resident, name, value)
    by_text = {}
    for i, r in zip(ids, rows, strict=True):
        if r:
            by_text.setdefault(r, []).append({"doc_id": i})
    table = pa.table({"text": list(by_text), "ids": pa.array(by_text.values(), pa.list_(pa.struct({"doc_id": pa.int64()})))})
    for shares in (1, 4):
        got = Counter()
        for share in range(shares):
            # each share sees the texts in an order of its own
            order = rng.sample(range(table.num_rows), table.num_rows)
            texts = resident.Texts(iter(table.take(order).to_batches(max_chunksize=4)), sum(map(len, by_text)) + len(by_text) + 100)
            for batch in resident.rows_of_share(texts, share, shares):
                assert batch.num_rows <= 5
                got.update(map(tuple, zip(*batch.to_pydict().values(), strict=True)))
        assert got == want


@pytest.mark.parametrize("kinds", (254, 256, 300, 70_000))
def test_many_different_characters(spark, monkeypatch, kinds):
    rng = random.Random(0)
    letters = [chr(i) for i in range(1, kinds + 3000) if not 0xD800 <= i < 0xE000][:kinds]
    rows = ["".join(rng.choices(letters[:4], k=80)), "".join(rng.choices(letters[-4:], k=80)), letters[-1] * 40, letters[-1] * 41, letters[-1] * 41, "".join(letters)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = by_row(intervals.leaf_depth_long(docs, 4, CUT)) if kinds > 300 else wanted(range(6), rows)
    assert by_row(held(docs, monkeypatch)) == want


def test_nothing_but_texts_is_shuffled(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, "ranks")

    depths = resident.leaf_depth_any(frame(spark, DEMO | {"2": DEMO["0"]}), 4, cut)
    plans.append(depths._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and "Generate" not in "".join(plans) and not any(x in plans[-1] for x in ("Exchange", "Sort", "Join"))


def test_what_cannot_be_held_goes_by_rounds(spark, monkeypatch):
    texts = DEMO | {"2": DEMO["0"]}
    for name in ("BYTES", "LONGEST"):
        with monkeypatch.context() as m:
            m.setattr(resident, name, 5)
            m.setattr(resident, "leaf_depths", None)
            assert got_depths(resident.leaf_depth_any(frame(spark, texts), 4, CUT)) == brute_depths(texts)


def test_query_of_documents_reads_texts_by_tasks(spark, monkeypatch):
    from stringloom.plans import catalogue

    monkeypatch.setattr(resident, "leaf_depth_any", lambda docs, k, cut: docs.limit(0))
    assert catalogue.QUERIES["leaf_depth_documents"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "text"]
