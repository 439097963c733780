"""Substring and suffix-array dedup against brute force over all windows."""

import hashlib
import random
import re
from dataclasses import replace

import numpy as np
import pytest

from stringloom.llm import substring_dedup, suffix_array_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = -(1 << 63)


def brute_words(docs, window=13):
    words = [(LOW if d is None else d, WORD.findall(t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    for (d, _), (own, w) in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < own:
                gone |= set(range(i, i + window))
        yield d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def brute_bytes(docs, window=100):
    texts = [(LOW if d is None else d, (t or "").encode()) for d, t in docs]
    least = {}
    for d, b in texts:
        for i in range(len(b) - window + 1):
            least[b[i : i + window]] = min(least.get(b[i : i + window], (d, i)), (d, i))
    for (d, _), (own, b) in zip(docs, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < (own, i):
                gone[i : i + window] = True
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        yield d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [["a", "b"], ["la", "é", "x", "yy", "🙂"], [f"w{i}" for i in range(500)]][seed % 3]
    say = lambda n: "".join(w + rng.choice((" ", " ", "\n", "\t ")) for w in rng.choices(vocabulary, k=n))
    passages = [say(rng.choice((5, 14, 40, 90))) for _ in range(5)]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else say(rng.randrange(60)) for _ in range(rng.randrange(1, 5))]
        docs.append((rng.choice((i, i, i, i // 2)), "".join(parts)))
    docs += [(1000 + i, docs[3][1]) for i in range(4)] + [(None, docs[5][1]), (None, None), (2000, ""), (2001, " \n "), docs[7], (2002, "z" * 5000), (2003, "q " * 3000)]
    rng.shuffle(docs)
    return docs


def rows(df):
    key = lambda r: tuple(LOW if x is None else x for x in r)
    return sorted(map(tuple, df.collect()), key=key)


@pytest.mark.parametrize(("seed", "hot"), [(0, 1000), (1, 1000), (2, 3), (3, 2), (4, 1)])
def test_against_brute_force(spark, seed, hot):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, block string").repartition(3)
    key = lambda r: tuple(LOW if x is None else x for x in r)
    assert rows(substring_dedup.op9(df, replace(substring_dedup.KIND, hot=hot))) == sorted(brute_words(docs), key=key)
    assert rows(suffix_array_dedup.op10(df, replace(suffix_array_dedup.KIND, hot=hot))) == sorted(brute_bytes(docs), key=key)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.op9(df).count() == 0
    assert suffix_array_dedup.op10(df).count() == 0


def test_long_text_over_strips(spark):
    rng = random.Random(9)
    long = " ".join(f"n{rng.randrange(3000)}" for _ in range(30000))
    docs = [(1, long), (2, long[50_000:90_000]), (3, long[:3000] + "!" + long[3000:20000])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substring_dedup.op9(df, replace(substring_dedup.KIND, strip=4096))) == sorted(brute_words(docs))
    assert rows(suffix_array_dedup.op10(df, replace(suffix_array_dedup.KIND, strip=4096))) == sorted(brute_bytes(docs))


def test_without_repeats_keeps_clean_rows(spark):
    docs = [(1, "a  b\nc " * 10, "s", None), (2, None, "s", 1), (3, "x y " + "a  b\nc " * 10, None, 2), (4, "one  two", "s", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    got = substring_dedup.without_repeats(df)
    assert got.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {1: (docs[0][1], None), 2: (None, 1), 3: ("x y", 2), 4: ("one  two", 3)}


def test_suffix_automaton_matching_statistics():
    rng = random.Random(3)
    for _ in range(30):
        texts = [[rng.choice((b"a", b"b", b"c")) for _ in range(rng.randrange(12))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        wanted = [rng.choice((b"a", b"b", b"c", b"d")) for _ in range(25)]
        inside = lambda part: any(part == t[i : i + len(part)] for t in texts for i in range(len(t)))
        for end, size in enumerate(automaton.matching_statistics(wanted), 1):
            assert size == max(n for n in range(end + 1) if n == 0 or inside(wanted[end - n : end]))


@pytest.mark.parametrize("seed", range(4))
def test_corpus_order_is_the_suffix_order(seed):
    rng = random.Random(seed)
    base = bytes(rng.choices(b"ab" if seed % 2 else b"abcdefgh", k=400))
    texts = [base[rng.randrange(200) : rng.randrange(200, 400)] + bytes(rng.choices(b"ab", k=9)) for _ in range(12)]
    off = np.cumsum([0, *map(len, texts)])
    order = suffix_array_dedup.corpus_order(np.frombuffer(b"".join(texts), np.uint8), off)
    suffixes = [t[i:] for t in texts for i in range(len(t))]
    assert [suffixes[i] for i in order] == sorted(suffixes)


def test_each_bucket_has_a_partition_of_its_own(spark):
    from stringloom.llm import blocks

    for n in (1, 2, 7, 51, 211):
        routes = blocks.keys_of_partitions(n)
        rows = spark.createDataFrame([(int(r), b) for b, r in enumerate(routes)], "route int, bucket int")
        found = rows.repartition(n, "route").selectExpr("spark_partition_id() AS p", "bucket").collect()
        assert sorted(r.p for r in found) == list(range(n)) and all(r.p == r.bucket for r in found)


def test_spans_of_a_reference(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    reference = [say(rng.randrange(60)) for _ in range(12)] + [[]]
    docs = [say(20) + reference[i][3:25] + say(5) + reference[(i + 1) % 12] for i in range(12)] + [reference[0], []]
    rows = [(i, " ".join(w), "c") for i, w in enumerate(docs)] + [(98, None, "c"), (0, " ".join(docs[0]), "c"), (99, "  ".join(reference[1][:5]), None)]
    texts = spark.createDataFrame([(" ".join(w),) for w in reference] + [(None,)], "text string")
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    known = {tuple(w[i : i + 6]) for w in reference for i in range(len(w) - 5)}
    want = []
    for i, text, c in rows:
        words = (text or "").split()
        gone = {j + k for j in range(len(words) - 5) if tuple(words[j : j + 6]) in known for k in range(6)}
        want.append((i, " ".join(w for j, w in enumerate(words) if j not in gone) if gone else text, c))
    key = lambda r: (r[0], r[1] or "", r[2] or "")
    for size in (60, 1 << 20):
        got = substring_dedup.without_reference(df, texts, 6, size)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert substring_dedup.without_reference(df, texts.limit(0), 6).count() == len(rows)
    assert substring_dedup.without_reference(df.limit(0), texts, 6).count() == 0
