"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree (orders 0 to 4) is counted on a bounded sample of labelled documents and
then frozen.  A byte costs -log2 of its PPM probability (method C without exclusions): symbol count over total plus distinct
in the longest seen context, or the escape share distinct over total plus distinct times the next shorter context, down to a
uniform byte.  A text goes to the language with the least code length over the whole text.

The trees of all languages are laid out together: for each n-gram seen in any language there is one row of code lengths, one
column a language, with all escapes already added.  Scoring is a table lookup for each byte; only n-grams seen in no language
go down to shorter contexts.

Bound of the sample: `ROWS_PER_LANG` rows for each language.  First come different texts up to `ROW_BYTES` bytes, by the hash of
the text; copies count once.  A language with fewer of them is filled up with pieces of its longer texts, each of
`ROW_BYTES // 4` characters: the first pieces by the hash of the text, then second pieces, and so on, from each text at most
its even share of the missing rows.

Defined results: null text and texts without a letter are `und` with score 0, as is everything if no row can be learned from;
rows with a null id or null language are not learned from; equal code lengths go to the first language by name; repeated
rows repeat their result; further columns are ignored by `op1` and kept by `known_language`.

`known_language` rejects a text without a letter, and one that no language explains: its least code length is more than
`EXCESS` bits above the 8 bits a byte of the uniform code, so bytes at random are the better model by a factor of over
2**EXCESS.  If no row can be learned from there is nothing to compare with, and every text with a letter stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stringloom.llm.shared import bounded_batches
from stringloom.llm.textkit import U64, groups_of_bytes, text_buffer, tidy

ORDER = 4
ROWS_PER_LANG = 400
ROW_BYTES = 16 << 10
UND = "und"
#: Bits by which the uniform code must beat the best language before a text is rejected; short texts rarely reach it.
EXCESS = 64.0
PAD = 0x0A
HASHES = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Index:
    """Maps 64-bit keys to their rank, by a few collision-free hash tables, each for what the one before could not place."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.levels: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left = np.arange(len(keys))
        level = 0
        while len(left):
            bits = max(4, int(4 * len(left)).bit_length())
            multiplier = HASHES[level % len(HASHES)] + U64(2 * (level // len(HASHES)))
            slot = (keys[left] * multiplier) >> U64(64 - bits)
            taken, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[taken.astype(np.int64)] = left[first]
            self.levels.append((multiplier, U64(64 - bits), table))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left = left[rest]
            level += 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Rank of each wanted key, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        open_ = None
        for multiplier, shift, table in self.levels:
            want = wanted if open_ is None else wanted[open_]
            rank = table[((want * multiplier) >> shift).astype(np.int64)]
            good = (rank >= 0) & (self.keys[rank] == want)
            if open_ is None:
                out[good] = rank[good]
                open_ = np.flatnonzero(~good)
            else:
                out[open_[good]] = rank[good]
                open_ = open_[~good]
            if not len(open_):
                break
        return out


def padded(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The texts with `order` line feeds before each, and the position of every text byte."""
    docs = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    place = np.arange(len(data), dtype=np.int64) + order * docs
    out = np.full(len(data) + order * (len(offsets) - 1), PAD, np.uint8)
    out[place] = data
    return out, place


def grams(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Code of the k bytes that end at each place."""
    code = np.zeros(len(place), U64)
    for back in range(k - 1, -1, -1):
        code = (code << U64(8)) | data[place - back].astype(U64)
    return code


class Trees:
    """The frozen context trees of all languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        count = len(self.languages)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for language in self.languages:
            rows = texts[language]
            off = np.concatenate([[0], np.cumsum([len(t) for t in rows])]).astype(np.int64)
            data, place = padded(np.frombuffer(b"".join(rows), np.uint8), off, order)
            for k in range(order + 1):
                seen[k].append(np.unique(grams(data, place, k + 1), return_counts=True))
        self.symbol: list[tuple[Index, np.ndarray]] = []
        self.escape: list[tuple[Index, np.ndarray]] = []
        for k in range(order + 1):
            union = np.unique(np.concatenate([g for g, _ in seen[k]])) if count else np.zeros(0, U64)
            heads = np.unique(union >> U64(8))
            cost, gone = np.zeros((len(union), count)), np.zeros((len(heads), count), np.float32)
            # what a gram costs in shorter contexts; a seen gram's tail is always seen one order lower
            tail = union & U64((1 << (8 * k)) - 1) if k else union
            lower = self.symbol[k - 1][1][self.symbol[k - 1][0].find(tail)].astype(float) if k else np.full((len(union), count), 8.0)
            of_head = np.searchsorted(heads, union >> U64(8))
            for j, (gram, c) in enumerate(seen[k]):
                at = np.searchsorted(union, gram)
                own = of_head[at]
                total = np.bincount(own, c, len(heads))
                kinds = np.bincount(own, minlength=len(heads))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out = np.where(kinds > 0, np.log2(total + kinds) - np.log2(kinds), 0)
                    cost[:, j] = lower[:, j] + out[of_head]
                    cost[at, j] = np.log2((total + kinds)[own]) - np.log2(c)
                gone[:, j] = out
            self.symbol.append((Index(union), cost.astype(np.float32)))
            self.escape.append((Index(heads), gone))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        text, place = padded(data, offsets, self.order)
        bits = np.zeros((len(data), len(self.languages)), np.float32)
        open_ = np.arange(len(data))
        for k in range(self.order, -1, -1):
            index, cost = self.symbol[k]
            code = grams(text, place[open_], k + 1)
            rank = index.find(code)
            hit = rank >= 0
            if k == self.order and hit.all():
                bits = cost[rank]
                open_ = open_[:0]
                break
            bits[open_[hit]] += cost[rank[hit]]
            open_, code = open_[~hit], code[~hit]
            if not len(open_):
                break
            heads, gone = self.escape[k]
            rank = heads.find(code >> U64(8))
            bits[open_[rank >= 0]] += gone[rank[rank >= 0]]
        bits[open_] += 8
        total = np.zeros((len(data) + 1, len(self.languages)))
        np.cumsum(bits, axis=0, dtype=np.float64, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


#: More than the wanted rows are let through by hash, so that chance does not leave the bound unfilled.
SPARE = 64


def training_sample(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, row_bytes: int = ROW_BYTES) -> DataFrame:
    """`lang, text` of at most `rows_per_lang` rows a language: different short texts by their hash, then pieces of longer ones.

    The counts of different texts say which share of the hash range is needed, so only a few times the bound reaches the final
    ranking."""
    held_in = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    usable = docs.where(F.col("lang").isNotNull() & held_in & F.col("text").isNotNull()).select(
        "lang", "text", (F.octet_length("text") > row_bytes).alias("long"), F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("hash")
    )
    texts = usable.groupBy("lang", "hash", "long").agg(F.count(F.lit(1)).alias("n"))
    counts = texts.groupBy("lang").agg(F.count_if(~F.col("long")).alias("n_short"), F.count_if("long").alias("n_long"))
    missing = F.greatest(F.lit(rows_per_lang) - F.col("n_short"), F.lit(0))
    below = lambda wanted, n: (2.0 * wanted + SPARE) * float(1 << 40) / F.greatest(F.col(n), F.lit(1))
    counts = counts.select(
        "lang",
        below(F.lit(rows_per_lang), "n_short").alias("below_short"),
        F.when(missing > 0, below(missing, "n_long")).otherwise(0.0).alias("below_long"),
        F.ceil(missing / F.greatest(F.col("n_long"), F.lit(1))).cast("int").alias("most"),
    )
    size = max(1, row_bytes // 4)
    few = usable.join(F.broadcast(counts), "lang").where(F.col("hash") < F.when(F.col("long"), F.col("below_long")).otherwise(F.col("below_short")))
    few = few.withColumn("text", F.when(F.col("long"), F.substring("text", F.lit(1), F.col("most") * size)).otherwise(F.col("text")))
    few = few.groupBy("lang", "long", "hash", "text").agg(F.count(F.lit(1)).alias("n"))
    last = F.when(F.col("long"), F.floor((F.length("text") - 1) / size)).otherwise(F.lit(0)).cast("int")
    few = few.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    few = few.withColumn("text", F.when(F.col("long"), F.substring("text", F.col("piece") * size + 1, F.lit(size))).otherwise(F.col("text")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "piece", "hash", "text"))
    return few.withColumn("rank", rank).where(F.col("rank") <= rows_per_lang).select("lang", "text")


def trained(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Trees:
    """Context trees from the bounded sample; what the driver collects is bounded by rows, bytes and languages."""
    texts: dict[str, list[bytes]] = {}
    for row in training_sample(docs, rows_per_lang).orderBy("lang", "text").toLocalIterator():
        texts.setdefault(row.lang, []).append(row.text.encode())
    return Trees(texts)


LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True


def predicted(texts: pa.Array, trees: Trees) -> tuple[list[str], list[float]]:
    return _rated(texts, trees)[:2]


def _rated(texts: pa.Array, trees: Trees) -> tuple[list[str], list[float], list[bool]]:
    """Language and score of each text, and whether `known_language` keeps it."""
    raw, off = text_buffer(texts)
    labels: list[str] = []
    scores: list[float] = []
    known: list[bool] = []
    for a, z in groups_of_bytes(off, 1 << 18):
        data, local = raw[off[a] : off[z]], off[a : z + 1] - off[a]
        letters = np.concatenate([[0], np.cumsum(LETTERS[data])])
        plain = letters[local[1:]] > letters[local[:-1]]
        # texts longer than a group are added up piece by piece, each with the bytes before it as context
        bits = trees.code_lengths(data, local) if len(data) <= 1 << 22 else _long(trees, data)
        for d in range(z - a):
            lettered = bool(plain[d]) or any(map(str.isalpha, data[local[d] : local[d + 1]].tobytes().decode("utf-8", "replace")))
            if not lettered or not trees.languages:
                labels.append(UND)
                scores.append(0.0)
                known.append(lettered)
                continue
            best = int(np.argmin(bits[d]))
            labels.append(trees.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(bits[d][best] - bits[d], -1000)).sum()))
            known.append(bool(bits[d][best] <= 8 * (local[d + 1] - local[d]) + EXCESS))
    return labels, scores, known


def _long(trees: Trees, data: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
    """Code lengths of one very long text, in pieces; a piece's first bytes are coded after the end of the piece before."""
    total = np.zeros((1, len(trees.languages)))
    k = trees.order
    for at in range(0, len(data), piece):
        part = data[max(0, at - k) : at + piece]
        total += trees.code_lengths(part, np.array([0, len(part)]))
        if at:
            total -= trees.code_lengths(part[:k], np.array([0, k]))
    return total


def identified(docs: DataFrame, trees: Trees, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs` plus the predicted language and score (input columns of these two names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = bounded_batches(docs).drop(label, score)
    at, names = rows.columns.index("text"), [*rows.columns, label, score]
    schema = rows.withColumns({label: F.lit(""), score: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = predicted(batch.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=names)

    return rows.mapInArrow(tidy(run), schema)


def op1(docs: DataFrame) -> DataFrame:
    found = identified(docs.select("doc_id", "text"), trained(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text has a letter and is explained by a language; columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs))
    rows = bounded_batches(docs)
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_rated(batch.column(at), shared.value)[2], pa.bool_()))

    return rows.mapInArrow(tidy(run), rows.schema)
