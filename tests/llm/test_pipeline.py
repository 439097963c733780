"""The pipeline's stages on planted documents."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice(('ka', 'lo', 'mi'))}{rng.randrange(900)}w" for _ in range(n))
    item, passage = say(30), say(60)
    rows = [(i, say(80), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    near = rows[3][1].split()
    near[7] = "other"
    rows += [(100, rows[5][1], "en", "s"), (101, " ".join(near), "en", "s"), (102, say(9) + " " + item + " " + say(9), "en", "s")]
    rows += [(103, say(40) + " " + passage, "de", "s"), (104, say(40) + " " + passage + " " + say(40), "en", "s"), (105, "123 ---", "en", "s"), (106, None, None, None), (107, "", "en", "s")]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(range(40)) | {103, 104}
    assert all(got[i].text == texts[i] for i in [*range(40), 103])
    words = texts[104].split()
    assert got[104].text == " ".join(words[:40] + words[100:]) and got[104].n_chars == len(got[104].text)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) > 0 for r in got.values())


def test_columns_and_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
