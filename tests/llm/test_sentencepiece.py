"""Viterbi over the automaton against plain dynamic programming, and exact round trips."""

import random

import pytest

from stringloom.llm import sentencepiece_viterbi as sv


def plain(text, vocabulary):
    scores = {}
    for i, (p, s) in enumerate(vocabulary.pieces):
        if p and (p not in scores or s > scores[p][0]):
            scores[p] = (s, i)
    lowest = min(s for s, _ in scores.values()) - sv.UNKNOWN_PENALTY
    longest = max(map(len, scores))
    best = [0.0] + [None] * len(text)
    for i in range(1, len(text) + 1):
        options = [best[j] + scores[text[j:i]][0] for j in range(max(0, i - longest), i) if text[j:i] in scores]
        if text[i - 1] not in scores:
            options.append(best[i - 1] + lowest)
        best[i] = max(options)
    return best[-1], scores, lowest


def score_of(ids, text, vocabulary, lowest):
    total, at, waiting = 0.0, 0, 0
    known = set(vocabulary.byte_ids)
    for i in ids:
        if i in known:
            if not waiting:
                waiting = len(text[at].encode())
                at, total = at + 1, total + lowest
            waiting -= 1
        else:
            assert not waiting
            piece, score = vocabulary.pieces[i]
            assert text.startswith(piece, at)
            at, total = at + len(piece), total + score
    assert at == len(text)
    return total


@pytest.fixture(scope="module")
def vocabulary():
    return sv.Vocabulary.load()


@pytest.mark.parametrize("seed", range(6))
def test_best_scores(vocabulary, seed):
    rng = random.Random(seed)
    own = sv.Segmenter(vocabulary, cache=5)
    letters = ["the and", "ab \n\t", "éüñ 日本語", "▁ a", "😀x  ", "   \n"][seed]
    for n in (0, 1, 2, 7, 60):
        text = "".join(rng.choices(letters, k=n))
        ids = sv.np.frombuffer(own.encode(text), sv.np.int32)
        assert own.decode(ids) == text if text else not len(ids)
        if text:
            best, _, lowest = plain(" " + text, vocabulary)
            assert score_of(ids.tolist(), " " + text, vocabulary, lowest) == pytest.approx(best)


def test_pieces_that_reach_across_spaces():
    vocabulary = sv.Vocabulary([("a b", 5.0), ("a", -1.0), (" ", -1.0), ("b", -1.0), *[("", 0.0)] * 256], list(range(4, 260)))
    own = sv.Segmenter(vocabulary)
    assert sv.np.frombuffer(own.encode("a b"), sv.np.int32).tolist() == [2, 0]


def test_runs_of_repeated_characters(vocabulary):
    """A character that stands next to itself in a piece, and in no other company, is not cut from itself."""
    own = sv.Segmenter(vocabulary)
    runs = {p.strip() for p, _ in vocabulary.pieces if len(p.strip()) > 1 and len(set(p.strip())) == 1}
    assert {"──", "══"} <= runs
    for run in sorted(runs):
        for text in (run, "x" + run + run[0] + " " + run + "."):
            ids = sv.np.frombuffer(own.encode(text), sv.np.int32)
            best, _, lowest = plain(" " + text, vocabulary)
            assert own.decode(ids) == text
            assert score_of(ids.tolist(), " " + text, vocabulary, lowest) == best


def test_table(spark, vocabulary):
    texts = [None, "", " ", "  x ", "\n", "▁▁ a▁", "word " * 30000, "dup", "dup", "\x00"]
    df = spark.createDataFrame([(i, t, [1], "c") for i, t in enumerate(texts)] + [(None, "n", None, None)], "doc_id long, text string, piece_ids array<int>, decoded string")
    both = sv.decoded(sv.encoded(df, vocabulary), vocabulary).collect()
    assert len(both) == 11 and all(r.decoded == r.text for r in both)
    assert [r.piece_ids for r in both if r.text is None] == [None]
    rows = sv.op7(df).collect()
    assert len(rows) == 11 and all(r.round_trip for r in rows)
    assert sv.op7(df.limit(0)).count() == 0


def test_merge_models_give_the_ids_of_their_own_encoder(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=sv.MODEL)
    vocabulary = sv.Vocabulary.of_model()
    assert vocabulary.merges
    own = sv.Segmenter(vocabulary, cache=50, pairs=50)
    rng = random.Random(3)
    letters = "abcdefghij ABCDE  0123\n\t.,-_─═éüñ中文字😀"
    texts = ["".join(rng.choices(letters, k=rng.randrange(200))) for _ in range(200)]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    texts += [r.text for r in rows.collect()]
    for text in texts:
        if sv.MARK not in text:
            assert sv.np.frombuffer(own.encode(text), sv.np.int32).tolist() == theirs.encode(text)
    both = sv.encoded(rows, vocabulary, back_col="back").collect()
    assert all(r.back == r.text and (sv.MARK in r.text or r.piece_ids == theirs.encode(r.text)) for r in both)
