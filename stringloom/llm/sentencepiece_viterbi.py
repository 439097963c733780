"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reads a text once.  At each position its output links list all pieces that end there, and each relaxes the best
way to that position.  What is best depends on the model file:

* Scores that are log probabilities are added up, and the greatest total wins; of equal ones the one whose last piece is
  longest.  A character that is no piece costs the model's unknown score.
* A merge model (byte-pair encoding) has merge ranks for scores, which do not add up.  There a piece may follow a piece only if
  merging the characters of both ends with these two; a segmentation is the one that merging gives if and only if all its
  neighbours may follow each other, so exactly one piece relaxes each position.  The ids are those of the model's own encoder.

A character that is no piece is written as its byte pieces.

Texts are cut where no piece can reach across: before a run of spaces that follows another character, and between
characters that stand next to each other in no piece, directly or over others (letters and full stops, say).  The best segmentation of a text is the joined best segmentations of its parts, so parts are looked
up in a two-generation cache of bounded size and only new ones are run through the automaton.

A space is written as the piece mark; a text gets one leading space (dummy prefix) that decoding removes.  The mark character
itself, where it occurs in a text, is written as bytes, so decoding always gives the exact text back.

Defined results: null text has null ids and decodes to null; empty text has no ids and decodes to the empty text; repeated
rows repeat their result; further columns are kept and a clashing `piece_ids` is replaced.  The mark character is the one case
in which ids differ from the model's own encoder, which takes it for a space.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.shared import bounded_batches
from stringloom.llm.textkit import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts, and pairs of pieces, of a generation of a cache.
CACHE, PAIRS = 150_000, 250_000
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces, scores and byte pieces of a model; small (one entry a piece), read on the driver and broadcast."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], merges: bool = False):
        #: "" for pieces that are never matched (control, unknown, byte); `merges` says that scores are merge ranks.
        self.pieces, self.byte_ids, self.merges = pieces, byte_ids, merges

    @classmethod
    def load(cls, model: str = MODEL, merges: bool = False) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces, byte_ids = [], [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
            skip = sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
            pieces.append(("" if skip else sp.id_to_piece(i).replace(MARK, " "), sp.get_score(i)))
        return cls(pieces, byte_ids, merges)

    @classmethod
    def of_model(cls, model: str = MODEL) -> Vocabulary:
        """The vocabulary as its file means it: merge ranks are whole numbers, log probabilities are not."""
        own = cls.load(model)
        own.merges = all(s == round(s) for p, s in own.pieces if p)
        return own


def parts_pattern(pieces: list[str]) -> re.Pattern[str]:
    """A pattern whose matches cut a text only where no piece reaches across.

    Characters next to each other in some piece are joined into classes, a character that is only next to itself into one of
    its own; between characters of two classes a text may be cut, and so it may before a run of spaces if no piece has a space
    after another character."""
    above: dict[str, str] = {}

    def top(c: str) -> str:
        above.setdefault(c, c)
        while above[c] != c:
            above[c] = c = above[above[c]]
        return c

    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            if a != " " and b == " ":
                return re.compile(".+", re.S)
            if a != " ":
                above[top(a)] = top(b)
    classes: dict[str, list[str]] = {}
    for c in list(above):
        classes.setdefault(top(c), []).append(c)
    joined = sorted((sorted(m) for m in classes.values()), key=lambda m: (-len(m), m))
    return re.compile(f" *(?:{'|'.join([*('[' + ''.join(map(re.escape, m)) + ']+' for m in joined), '[^ ]'])})| +", re.S)


class Recent:
    """A mapping of two generations: the older one goes when the younger one is full."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Segmenter:
    """The automaton with its caches; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE, pairs: int = PAIRS):
        self.pieces, self.byte_ids = vocabulary.pieces, vocabulary.byte_ids
        #: Score and id of each piece; the best of equal ones.
        self.score: dict[str, tuple[float, int]] = {}
        for i, (piece, score) in enumerate(self.pieces):
            if piece and (piece not in self.score or score > self.score[piece][0]):
                self.score[piece] = (score, i)
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in self.score.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        if self.score:
            self.automaton.make_automaton()
        self.lowest = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_PENALTY
        self.bytes = [p.encode() for p, _ in self.pieces]
        for value, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([value])
        self.parts = parts_pattern(list(self.score))
        self.segment = self.merged if vocabulary.merges else self.likeliest
        self.recent, self.pairs = Recent(cache), Recent(pairs)

    def _matches(self, text: str) -> Iterator[tuple[int, tuple[int, float, int]]]:
        """(last position, (length, score, id)) of each piece in the text, by last position, longest first."""
        return self.automaton.iter(text) if self.score else iter(())

    def likeliest(self, text: str) -> list[int]:
        """Ids of the segmentation of greatest total score (no prefix is added)."""
        n = len(text)
        best, via = [0.0] + [-math.inf] * n, [None] * (n + 1)
        at, lowest = 0, self.lowest
        for end, piece in self._matches(text):
            while at < end:
                at += 1
                if best[at - 1] + lowest > best[at]:
                    best[at], via[at] = best[at - 1] + lowest, None
            value = best[end + 1 - piece[0]] + piece[1]
            if value > best[end + 1]:
                best[end + 1], via[end + 1] = value, piece
        # what follows the last piece is unknown, so its places need no score
        return self._ids(text, via)

    def merged(self, text: str) -> list[int]:
        """Ids of the segmentation that merging gives (no prefix is added)."""
        via: list[tuple[int, float, int] | None] = [None] * (len(text) + 1)
        # the piece before each place, as the upper half of a pair's key; 0 where there is none
        before = [0] * (len(text) + 1)
        known = self.pairs.young
        for end, piece in self._matches(text):
            end += 1
            if via[end] is None:
                key = before[end - piece[0]] | piece[2]
                follows = known.get(key)
                if follows is None:
                    follows = self.follows(key)
                    known = self.pairs.young
                if follows:
                    via[end] = piece
                    before[end] = piece[2] + 1 << 32
        return self._ids(text, via)

    def follows(self, key: int) -> bool:
        """Whether merging the characters of both pieces of a pair (of one, if there is none before) ends with them."""
        known = self.pairs.get(key)
        if known is None:
            one, two = (key >> 32) - 1, key & 0xFFFFFFFF
            known = self._merges_to(self.pieces[one][0] if one >= 0 else "", self.pieces[two][0])
            self.pairs.put(key, known)
        return known

    def _merges_to(self, one: str, two: str) -> bool:
        parts = list(one + two)
        # score of each two neighbours joined, and how many parts are left of the border
        score = [self._score_of(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        left = len(one)
        while score:
            top = max(score)
            if top == -math.inf:
                break
            at = score.index(top)
            if at + 1 == left:
                return False
            left -= at < left
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del score[at]
            if at:
                score[at - 1] = self._score_of(parts[at - 1] + parts[at])
            if at < len(score):
                score[at] = self._score_of(parts[at] + parts[at + 1])
        return parts == ([one, two] if one else [two])

    def _score_of(self, piece: str) -> float:
        hit = self.score.get(piece)
        return -math.inf if hit is None else hit[0]

    def _ids(self, text: str, via: list[tuple[int, float, int] | None]) -> list[int]:
        ids: list[int] = []
        n = len(text)
        while n:
            piece = via[n]
            if piece is None:
                ids += [self.byte_ids[b] for b in reversed(text[n - 1].encode())]
                n -= 1
            else:
                ids.append(piece[2])
                n -= piece[0]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian int32 ids of a text with its dummy prefix."""
        if not text:
            return b""
        out = []
        recent = self.recent
        known = recent.young
        for part in self.parts.findall(" " + text):
            ids = known.get(part)
            if ids is None:
                ids = recent.get(part)
                if ids is None:
                    ids = array("i", self.segment(part)).tobytes()
                    if len(part) <= 64:
                        recent.put(part, ids)
                known = recent.young
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.bytes
        return b"".join([pieces[i] for i in ids.tolist()])[1:].decode()


_segmenters: dict[int, Segmenter] = {}


def segmenter(shared) -> Segmenter:
    """This worker's segmenter for a broadcast vocabulary."""
    if shared.id not in _segmenters:
        _segmenters.clear()
        _segmenters[shared.id] = Segmenter(shared.value)
    return _segmenters[shared.id]


class _Shared:
    """A broadcast with a stable id, to find the worker's own automaton again."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.id = hash((tuple(vocabulary.pieces), tuple(vocabulary.byte_ids), vocabulary.merges))

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def id_lists(packed: list[bytes | None]) -> pa.Array:
    """Encoded ids as an Arrow list column."""
    sizes = np.cumsum([0, *(len(p or b"") // 4 for p in packed)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(sizes), values, mask=pa.array([p is None for p in packed]))


def encoded(docs: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids", back_col: str | None = None) -> DataFrame:
    """All columns of `docs` plus `piece_ids array<int>`, and with `back_col` the text decoded from them again, in one pass."""
    shared = _Shared(docs.sparkSession, vocabulary)
    rows = bounded_batches(docs).drop(ids_col, *([back_col] if back_col else []))
    at, names = rows.columns.index("text"), [*rows.columns, ids_col, *([back_col] if back_col else [])]
    schema = rows.withColumns({ids_col: F.lit(None).cast("array<int>")} | ({back_col: F.lit(None).cast("string")} if back_col else {})).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(shared)
        for whole in batches:
            for first in range(0, whole.num_rows, 250):
                batch = whole.slice(first, 250)
                packed = [None if t is None else own.encode(t) for t in batch.column(at).to_pylist()]
                columns = [*batch.columns, id_lists(packed)]
                if back_col:
                    columns.append(pa.array([None if p is None else own.decode(np.frombuffer(p, np.int32)) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(tidy(run), schema)


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """All columns plus the text of `piece_ids`."""
    shared = _Shared(rows.sparkSession, vocabulary)
    rows = rows.drop(text_col)
    at, names = rows.columns.index(ids_col), [*rows.columns, text_col]
    schema = rows.withColumn(text_col, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(shared)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                column = batch.column(at)
                texts = [None if not column[i].is_valid else own.decode(column[i].values.to_numpy()) for i in range(len(column))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(tidy(run), schema)


def op7(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """For each document: its number of pieces, digests of ids and decoded text, and whether decoding gave the text back."""
    both = encoded(docs.select("doc_id", "text"), Vocabulary.of_model(model), back_col="decoded")
    return both.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
