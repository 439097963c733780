"""Wu-Manber decontamination against a plain search for every window."""

import hashlib
import random
import re

import pytest

from stringloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := patterns.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hit int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    if options:
        found = decontaminate.hits(d, b, **options).select("doc_id", "hit").collect()
        got = [(r.doc_id, r.hit.n_words, decontaminate.hit_words(r.hit.n_words, bytes(r.hit.spans)), len(r.hit["items"])) for r in found]
        assert sorted(got, key=key) == sorted((x[:4] for x in brute(docs, items)), key=key)
    else:
        assert sorted(map(tuple, decontaminate.op2(d, b).collect()), key=key) == sorted(brute(docs, items), key=key)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "zz9", "Q"][: rng.choice((2, 3, 5))]
    say = lambda n: rng.choice((" ", ", ", "\n")).join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice((0, 1, 2, 3, 9, 10, 11, 30)))) for i in range(2 if len(vocabulary) < 5 else 6)]
    docs = [(i, say(rng.choice((0, 1, 5, 40, 700)))) for i in range(40)]
    check(spark, docs, items)


def test_edges(spark):
    line = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, "..."), (None, f"x {line.upper()} y"), (4, line), (4, line), (5, line.replace(" ", "--")), (6, line[:-7]), (7, "w " * 70000 + line)]
    items = [(1, line), (10, line), (2, None), (3, "  "), (None, "seven eight nine ten eleven"), (1, line)]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)
    check(spark, docs, items, block_bytes=1)


def test_clean_documents_keep_columns(spark):
    line = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, line, "a"), (2, "fine", "b"), (3, None, None)], "doc_id long, text string, hit string")
    b = spark.createDataFrame([(1, line)], "item_id long, text string")
    got = decontaminate.clean_documents(d, b)
    assert got.columns == d.columns and sorted((r.doc_id, r.hit or "") for r in got.collect()) == [(2, "b"), (3, "")]
