"""PPM code lengths against a plain recursive PPM, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.llm import lang_id

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain_bits(texts, wanted, order=lang_id.ORDER):
    counts = defaultdict(Counter)
    for t in texts:
        b = b"\n" * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    total, b = 0.0, b"\n" * order + wanted
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = counts.get(b[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if seen[b[i]]:
                total += math.log2(whole / seen[b[i]])
                break
            total += math.log2(whole / len(seen))
        else:
            total += 8
    return total


@pytest.mark.parametrize("seed", range(3))
def test_code_lengths(seed):
    rng = random.Random(seed)
    say = lambda letters, n: "".join(rng.choices(letters, k=n)).encode()
    texts = {"x": [say("ab", 50), say("abé", 90), b""], "y": [say("bcd", 80)], "z": [b"q"]}
    trees = lang_id.Trees(texts)
    wanted = [say("abcdeé", 60), b"", b"q", say("ab", 200), bytes(range(256))]
    off = np.cumsum([0, *map(len, wanted)])
    got = trees.code_lengths(np.frombuffer(b"".join(wanted), np.uint8), off)
    for row, text in zip(got, wanted, strict=True):
        assert row == pytest.approx([plain_bits(texts[k], text) for k in "xyz"], abs=1e-3)
    long = np.frombuffer(say("abcd", 1000), np.uint8)
    assert lang_id._long(trees, long, 64)[0] == pytest.approx(trees.code_lengths(long, np.array([0, 1000]))[0], abs=1e-2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = lang_id.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_edges(spark):
    rows = [(i, "the cat and the dog " * 3, "en", "a", 0.5) for i in range(9)] + [(100 + i, "der hund und die katze " * 3, "de", "b", 0.5) for i in range(9)]
    rows += [(50, None, "en", "", 0.0), (51, "", None, "", 0.0), (52, "123 .,", "en", "", 0.0), (53, "é", None, "", 0.0), (None, "the dog", "en", "", 0.0), (54, "und der hund " * 40000, None, "", 0.0), (54, "und der hund", None, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = {(r.doc_id, r.lang_pred): r for r in lang_id.op1(df).collect()}
    assert {(50, "und"), (51, "und"), (52, "und"), (54, "de"), (None, "en")} <= set(got)
    assert got[50, "und"].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert lang_id.op1(df).count() == len(rows)
    kept = lang_id.known_language(df)
    assert kept.columns == df.columns and kept.where(F.col("doc_id").isin(50, 51, 52)).count() == 0
    assert kept.where("lang_pred = 'a'").count() == 9
    nothing = lang_id.op1(df.limit(0))
    assert nothing.count() == 0
    assert {r.lang_pred for r in lang_id.op1(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_stage_rejects_what_no_language_explains(spark):
    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(400))
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(9)] + [(50, noise, None), (51, "the dog", None), (52, "12 .", None), (53, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in lang_id.known_language(df).collect()} == {*range(9), 51, 53}
    # nothing to learn from: every text with a letter stays
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in lang_id.known_language(bare).collect()} == {*range(9), 50, 51, 53}


def test_sample_counts_copies_once(spark):
    texts = spark.range(200).select("id", F.concat(F.lit("text "), "id").alias("text"))
    copies = spark.range(1000, 61000).select("id", F.lit("text 7").alias("text"))
    docs = texts.union(copies).select((F.col("id") * 4).alias("doc_id"), "text", F.lit("en").alias("lang"))
    free = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = [r.text for r in lang_id.training_sample(docs).collect()]
    assert sorted(got) == sorted(r.text for r in free.select("text").distinct().collect()) and len(got) > 100
    assert len(set(r.text for r in lang_id.training_sample(docs, 30).collect())) == 30


def test_sample_is_filled_from_longer_texts(spark):
    word = lambda i: f"w{i} "
    rows = [(i, word(i), "a") for i in range(40)] + [(100 + i, word(i) * 40, "a") for i in range(40)]
    rows += [(200 + i, "é" * 30 + word(i) * 40, "b") for i in range(3) for _ in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    free = {r.doc_id: r for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).collect()}
    short = {r.text for r in free.values() if len(r.text.encode()) <= 64}
    got = lang_id.training_sample(docs, 50, 64).collect()
    own = [r.text for r in got if r.lang == "a"]
    assert len(own) == 50 and short <= set(own)
    assert all(len(r.text.encode()) <= 64 and any(r.text in x.text for x in free.values()) for r in got)
    pieces = [r.text for r in got if r.lang == "b"]
    long = {r.text for r in free.values() if r.lang == "b"}
    assert long and {t[:16] for t in long} == {p for p in pieces if p.startswith("é" * 16)}
    assert len(pieces) > len(long)


def test_predictions_do_not_depend_on_batches():
    trees = lang_id.Trees({"a": [b"aaab" * 50], "b": [b"bbba" * 50]})
    texts = ["ab" * 9, None, "b" * 600000, "aaab"]
    whole = lang_id.predicted(pa.array(texts), trees)
    assert whole == tuple(map(list, zip(*(tuple(x[0] for x in lang_id.predicted(pa.array([t], pa.string()), trees)) for t in texts), strict=True)))
