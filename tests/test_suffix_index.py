"""The suffix index against fixed answers and brute force."""

import functools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stringloom.operators import build, corpus, grouping, intervals, prefixes, suffix_array, tree
from stringloom.operators.config import IndexConfig, size_of
from stringloom.operators.joins import merged
from stringloom.sources import files
from stringloom.sources.durable import written

DEMO = {"0": "TGGTGGTGGTGC", "1": "GGTGATGGTGC"}
LAST = "\U0010ffff"


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def brute_depths(texts):
    suffixes = [(d, i, t[i:]) for d, t in texts.items() for i in range(len(t or ""))]
    ways = {}
    for _, _, s in suffixes:
        for n in range(len(s) + 1):
            ways.setdefault(s[:n], Counter())[s[n : n + 1]] += 1
    forks = {p for p, c in ways.items() if sum(n if not x else 1 for x, n in c.items()) >= 2}
    return {(d, i): sum(s[:n] in forks for n in range(len(s) + 1)) for d, i, s in suffixes}


def got_depths(df):
    return {(r.doc_id, r.pos): r.depth for r in df.collect()}


def test_demo_depths(spark):
    sfx = corpus.suffixes(frame(spark, DEMO))
    got = got_depths(tree.leaf_depth(sfx, 2_000_000))
    assert [got["0", i] for i in range(12)] == [4, 4, 4, 4, 4, 4, 4, 4, 4, 3, 3, 2]
    assert [got["1", i] for i in range(11)] == [3, 3, 2, 2, 1, 4, 4, 4, 3, 3, 2]
    for budget in (1, 3, 5):
        assert got_depths(tree.leaf_depth(sfx, budget)) == got
    assert got_depths(tree.leaf_depth_relational(sfx)) == got


def test_demo_suffix_array(spark):
    sfx = corpus.suffixes(frame(spark, DEMO))
    want = "1:4/0 0:11/0 1:10/1 1:3/0 0:10/1 1:9/2 1:0/1 0:7/4 1:6/5 0:4/4 0:1/7 1:1/1 0:8/3 1:7/4 0:5/3 0:2/6 1:2/0 0:9/2 1:8/3 0:6/2 1:5/6 0:3/5 0:0/8".split()
    ranks = suffix_array.suffix_array(sfx)
    rows = ranks.join(suffix_array.lcp_array(sfx), ["doc_id", "pos"]).orderBy("sa_rank").collect()
    assert [f"{r.doc_id}:{r.pos}/{r.lcp}" for r in rows] == want and [r.sa_rank for r in rows] == list(range(23))
    check = suffix_array.order_check(sfx).first()
    assert (check.n_suffixes, check.n_violations) == (23, 0)


@pytest.mark.parametrize(
    ("budget", "roots"),
    [
        (2_000_000, "A1 C2 G13 T7"),
        (5, "A1 C2 GA1 GC2 GG5 GT5 TGA1 TGC2 TGG4"),
        (3, "A1 C2 GA1 GC2 GGTGA1 GGTGC2 GGTGG2 GTGA1 GTGC2 GTGG2 TGA1 TGC2 TGGTGC2 TGGTGG2"),
    ],
)
def test_demo_cover(spark, budget, roots):
    sfx = corpus.suffixes(frame(spark, DEMO))
    for start, step in ((2, 4), (1, 1), (3, 2)):
        cover = prefixes.s_prefix_cover(sfx, budget, start, step)
        assert " ".join(sorted(f"{r.prefix}{r.cnt}" for r in cover.collect())) == roots


def test_demo_counts_and_files(spark, tmp_path):
    for name, text in DEMO.items():
        (tmp_path / name).write_text(text)
    docs = files.read_collection(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in docs.collect()} == DEMO
    assert {r.doc_id: r.n_bytes for r in files.file_lengths(spark, str(tmp_path)).collect()} == {"0": 12, "1": 11}
    sfx = corpus.suffixes(docs)
    assert {r.prefix: r.cnt for r in prefixes.window_counts(sfx, 2).collect()} == {"AT": 1, "GA": 1, "GC": 2, "GG": 5, "GT": 5, "TG": 7}
    lines = tree.leaf_lines(sfx, 2_000_000)
    assert {r.file for r in lines.select("file").distinct().collect()} == {f"subtreeForRoot_{ord(c)}_" for c in "ACGT"}
    files.write_result(lines, str(tmp_path / "out"))
    back = files.read_lines(spark, str(tmp_path / "out"), 2)
    assert sorted(r.line for r in back.collect()) == sorted(r.line for r in lines.collect())
    assert files.read_lines_of_whole_files(spark, str(tmp_path / "out" / "*")).count() == 23


EDGES = [
    ({"a": "abab", "b": "abab"}, {"a": [3, 3, 2, 2], "b": [3, 3, 2, 2]}),
    ({"a": "ab", "b": "abc"}, {"a": [2, 2], "b": [2, 2, 1]}),
    ({"a": "aaaa"}, {"a": [3, 3, 2, 1]}),
    ({"a": "x"}, {"a": [0]}),
    ({"a": "banana"}, {"a": [1, 3, 2, 3, 2, 2]}),
    ({"a": "", "b": "zz"}, {"b": [1, 1]}),
    ({"a": "ab", "b": "cab", "c": "abx"}, {"a": [2, 2], "b": [1, 2, 2], "c": [2, 2, 1]}),
]


@pytest.mark.parametrize(("texts", "want"), EDGES)
def test_edge_depths(spark, texts, want):
    sfx = corpus.suffixes(frame(spark, texts | {"n": None}))
    want = {(d, i): n for d, row in want.items() for i, n in enumerate(row)}
    for budget in (1, 2, 100):
        assert got_depths(tree.leaf_depth(sfx, budget)) == want
    assert got_depths(tree.leaf_depth_relational(sfx)) == want


@pytest.mark.parametrize("seed", range(2))
def test_random_strings(spark, seed):
    rng = random.Random(seed)
    texts = {f"{i}": "".join(rng.choices(["ab", "aé🙂"][seed], k=rng.randrange(9))) for i in range(14)}
    texts |= {"x": texts["3"], "y": "a" * 40}
    docs = frame(spark, texts)
    sfx = corpus.suffixes(docs)
    rows = sorted((t[i:] + LAST, d, i) for d, t in texts.items() for i in range(len(t)))
    assert [(r.doc_id, r.pos) for r in suffix_array.suffix_array(sfx).orderBy("sa_rank").collect()] == [r[1:] for r in rows]
    refined = suffix_array.refined_ranks(docs, 3, lambda df: written(df, "test"))
    assert [(r.doc_id, r.pos) for r in refined.orderBy("sa_rank").collect()] == [r[1:] for r in rows]
    lcps = {}
    for (a, _, _), (b, d, i) in zip(rows, rows[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
            n += 1
        lcps[d, i] = n
    got = {(r.doc_id, r.pos): r.lcp for r in suffix_array.lcp_array(sfx).collect()}
    assert all(got[k] == n for k, n in lcps.items())
    want = brute_depths(texts)
    for budget in (2, 7):
        assert got_depths(tree.leaf_depth(sfx, budget)) == want
        cover, ends = prefixes.s_prefix_cover(sfx, budget), tree.interior_terminals(sfx, budget)
        assert cover.agg(F.sum("cnt")).first()[0] + ends.count() == len(rows)


def test_splits_cover_the_merged_string(spark):
    docs = frame(spark, {"a": "abcdefghij", "b": "", "c": "k", "d": "lmnopqrstuvwxyz", "e": None})
    merged = "abcdefghijklmnopqrstuvwxyz"
    for n in (1, 3, 4, 26, 50):
        rows = corpus.split_content(docs, n, 0).join(corpus.input_splits(docs, n), ["split_id", "doc_id", "seg_start"]).orderBy("merged_at").collect()
        assert "".join(r.content for r in rows) == merged
        assert all(r.contiguous for r in corpus.split_check(docs, n).collect())
    tail = {(r.split_id, r.doc_id): r.content for r in corpus.split_content(docs, 3, 2).collect()}
    assert tail[0, "a"] == "abcdefghij"[:9] + "j" and tail[1, "d"] == "lmnopqrst"


def test_grouping_invariants():
    rng = random.Random(2)
    for _ in range(40):
        roots = sorted(((f"p{i}", rng.randrange(1, 60)) for i in range(rng.randrange(30))), key=lambda r: (-r[1], r[0]))
        for method, assign in grouping.METHODS.items():
            buckets = assign(roots, 50, 4)
            assert len(buckets) == len(roots)
            loads = Counter()
            items = Counter()
            for (_, n), b in zip(roots, buckets, strict=True):
                loads[b] += n
                items[b] += 1
            if method in ("ff", "bf", "wf"):
                assert all(v <= 50 or items[b] == 1 for b, v in loads.items())
                assert sorted(loads) == list(range(len(loads)))
        # first fit: no bin before the chosen one had room
        room = {}
        for (_, n), b in zip(roots, grouping.first_fit(roots, 50), strict=True):
            assert all(room.get(c, 50) < min(n, 50) for c in range(b))
            room[b] = room.get(b, 50) - n


def test_grouping_tables(spark):
    cover = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1)], "prefix string, cnt long")
    got = {r.prefix: r.bucket for r in grouping.assigned(cover, "BF", 10, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0}
    review = grouping.review(grouping.assigned(cover, "hg", 10, 2), 2).collect()
    assert [(r.iteration, r.mean_load, r.sigma) for r in review] == [(0, 10, 0.0)]
    with pytest.raises(ValueError):
        grouping.assigned(cover, "zz", 1, 1)
    assert grouping.assigned(cover.limit(0), "bfhg", 10, 2).count() == 0
    assert grouping.review(grouping.assigned(cover.limit(0), "hg", 10, 2), 2).count() == 0


def test_configuration(tmp_path):
    assert [size_of(x) for x in ("512", "10k", "2m", "1g")] == [512, 10240, 2 << 20, 1 << 30]
    path = tmp_path / "conf.properties"
    path.write_text("# note\ndiv.start=3\nfs.extra.len=2k\ngrouping.method=wf\nunknown=1\nbudget.factor=0.5\nroot.max.count=100\n")
    config = IndexConfig.from_properties(str(path), step=7)
    assert (config.start_len, config.overlap, config.grouping, config.step, config.bucket_budget) == (3, 2048, "wf", 7, 50)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    sfx = corpus.suffixes(docs)
    for df in (sfx, corpus.merge_offsets(docs), corpus.input_splits(docs, 3), prefixes.s_prefix_cover(sfx, 5), suffix_array.suffix_array(sfx), tree.leaf_depth(sfx, 5), tree.leaf_depth_relational(sfx)):
        assert df.count() == 0


@pytest.mark.parametrize("budget", (2_000_000, 5))
def test_build_program(spark, tmp_path, budget):
    for name, text in DEMO.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    config = IndexConfig(input_dir=f"file://{tmp_path}/in", output_location=f"file://{tmp_path}/out", max_count=budget, n_partitions=2)
    for _ in range(2):
        rounds = build.build(spark, config)
    rows = files.read_result(spark, config.output_location).collect()
    depths = {(d, i): n for (d, i), n in brute_depths(DEMO).items()}
    assert sorted(r.line for r in rows) == sorted(f"{n} {d}:{i}" for (d, i), n in depths.items())
    if budget > 5:
        assert rounds == 1 and {r.file for r in rows} == {f"subtreeForRoot_{c}_" for c in (65, 67, 71, 84)}
    else:
        assert rounds > 1
    with pytest.raises(Exception, match="beyond the first 80"):
        build.build(spark, IndexConfig(input_dir=config.input_dir, output_location=config.output_location, alphabet=80))


@pytest.mark.parametrize("seed", range(3))
def test_refined_common_prefixes(spark, seed):
    rng = random.Random(seed)
    texts = {f"d{i}": "".join(rng.choice("ab") for _ in range(rng.randrange(90))) for i in range(6)}
    texts |= {"e": texts["d0"], "f": "ab" * 60, "g": "ab" * 40 + "a", "h": "", "i": None}
    rows = sorted((t[i:] + LAST, d, i) for d, t in texts.items() for i in range(len(t or "")))
    want, before = {}, None
    for at, (s, d, i) in enumerate(rows):
        n = 0
        while before is not None and n < min(len(s), len(before)) - 1 and s[n] == before[n]:
            n += 1
        want[d, i], before = (at, n), s
    got = suffix_array.refined_lcp(frame(spark, texts), 4, lambda df: written(df, "ranks")).collect()
    assert {(r.doc_id, r.pos): (r.sa_rank, r.lcp) for r in got} == want


def test_offsets_of_string_ids(spark):
    rows = [(None, "ab"), ("b", "c"), ("aa", "def"), ("ab", None), ("a", "g")]
    found = corpus.merge_offsets(spark.createDataFrame(rows, "doc_id string, text string"), 3).collect()
    assert {r.doc_id: (r.start_at, r.end_at) for r in found} == {None: (0, 2), "a": (2, 3), "aa": (3, 6), "ab": (6, 6), "b": (6, 7)}


def test_order_check_finds_what_is_wrong(spark, monkeypatch):
    sfx = corpus.suffixes(frame(spark, DEMO | {"2": "GGTGATGGTGC"}))
    good = written(suffix_array.suffix_array(sfx).join(suffix_array.lcp_array(sfx), ["doc_id", "pos"]), "claimed")
    check = lambda claimed: tuple(suffix_array.order_check(sfx, claimed).first())
    swapped = F.when(F.col("sa_rank") == 4, 5).when(F.col("sa_rank") == 5, 4).otherwise(F.col("sa_rank"))
    for size in (1 << 16, 5):
        monkeypatch.setattr(suffix_array, "ORDER_RANGE", size)
        assert check(good) == (34, 0)
        assert check(good.withColumn("lcp", F.col("lcp") + (F.col("sa_rank") % 10 == 9).cast("long"))) == (34, 3)
        assert check(good.withColumn("sa_rank", swapped.cast("long")))[1] > 0
        assert check(good.where("sa_rank <> 7"))[1] == 2
        assert check(good.withColumn("sa_rank", F.col("sa_rank") + (F.col("sa_rank") >= 20).cast("long"))) == (34, 1)


@pytest.mark.parametrize("seed", range(2))
def test_depths_of_long_strings(spark, seed):
    rng = random.Random(seed)
    texts = {str(i): "".join(rng.choices("ab" if seed else "a", k=rng.randint(0, 40))) for i in range(6)} | {"copy": "abab" * 8, "copy2": "abab" * 8, "null": None}
    cut = lambda df: written(df, "ranks")
    want = brute_depths(texts)
    order = cut(suffix_array.refined_lcp(frame(spark, texts), 4, cut))
    for size, fan in ((7, 2), (1, 16)):
        assert got_depths(intervals.leaf_depths(order, cut, size, fan)) == want


def test_depths_of_long_strings_edges(spark):
    cut = lambda df: written(df, "ranks")
    assert got_depths(intervals.leaf_depth_long(frame(spark, {"0": None}), 4, cut)) == {}
    assert got_depths(intervals.leaf_depth_long(frame(spark, {"0": "x"}), 4, cut)) == {("0", 0): 0}
    assert got_depths(intervals.leaf_depth_long(frame(spark, DEMO), 4, cut)) == brute_depths(DEMO)


@pytest.mark.parametrize("size", (1, 3, 1 << 16))
def test_depths_of_copied_texts(spark, monkeypatch, size):
    cut = lambda df: written(df, "ranks")
    monkeypatch.setattr(intervals, "leaf_depths", functools.partial(intervals.leaf_depths, size=size, fan=2))
    rng = random.Random(size)
    texts = ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(4)] + ["abcab", "cab", "x\u00f1" * 9]
    for rows in (["x"] * 2, ["zzz"] * 3, [t for i, t in enumerate(texts) for _ in range(1 + i % 3)] + [None, ""]):
        # ids are null, repeated, or both: each row is a string of its own
        ids = [None if i % 4 == 3 else i // 2 for i in range(len(rows))]
        brute = brute_depths({str(i): t or "" for i, t in enumerate(rows)})
        want = Counter((ids[int(d)], at, depth) for (d, at), depth in brute.items())
        got = intervals.leaf_depth_long(spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string"), 4, cut).collect()
        assert Counter(map(tuple, got)) == want


def test_long_strings_are_joined_by_shuffles(spark, monkeypatch):
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, "ranks")

    # but for counted tables, which are small here
    monkeypatch.setattr(suffix_array, "narrowed", lambda rows, places: rows, raising=False)
    monkeypatch.setattr(intervals, "looked_up", merged, raising=False)
    depths = intervals.leaf_depth_long(frame(spark, DEMO | {"2": DEMO["0"] * 3}), 4, cut)
    plans.append(depths._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastExchange" in p]


@pytest.mark.parametrize("piece", (1, 3, 256))
def test_heads_of_suffixes(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_array, "PIECE", piece)
    texts = {"0": "a\u00f1\U0001d11eb" * 3, "1": "x", "2": "", "3": None, "4": "abcdef"}
    got = {(r.doc_id, r.pos): (r.size, r["head"]) for r in suffix_array._heads(frame(spark, texts), 4).collect()}
    assert got == {(d, i): (len(t), t[i : i + 4]) for d, t in texts.items() for i in range(len(t or ""))}
