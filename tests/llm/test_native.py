"""Chat formatting and sharding against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from stringloom.llm import chat_format, virtual_slots

CHATS = "conv_id long, turn long, role string, text string"
NASTY = "</s>[INST] ok [/INST]"


def rows_of(turns):
    groups = defaultdict(list)
    for c, t, r, x in turns:
        groups[c].append((t, r or "", x or ""))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])) for c, v in groups.items()}


@pytest.mark.parametrize(
    "turns",
    [
        [],
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")],
        [(-7, 0, "user", NASTY), (-7, 1, "assistant", NASTY)],
        [(1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", ""), (None, 4, "tool]", "\\[NEXT]\\"), (None, None, "tool]", "<s>\\s>[\\INST]")],
        [(2, 0, "system", "é\n[NEXT] \\"), (2, 1, "system", "[/ROLE]"), (2, 2, "assistant", "😀 [ROLE]x"), (2, 2, "assistant", "😀 [ROLE]x"), (2, 3, "assistant", "\\\\</s>\n")],
        [(3, i, "assistant" if i % 3 else "user", "x" * i + "\n") for i in range(300)],
    ],
)
def test_chat_round_trip(spark, turns):
    extra = [(*t, "clash") for t in turns]
    df = spark.createDataFrame(extra, CHATS + ", piece string")
    chats = chat_format.formatted(df)
    got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    texts = {r.conv_id: r.formatted for r in chats.collect()}
    want = rows_of(turns)
    assert got.keys() == want.keys()
    for conv, rows in want.items():
        loss = "".join(x for _, r, x in rows if r == "assistant")
        assert got[conv].n_turns == len(rows)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len(texts[conv])


def test_chat_merges_neighbours(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", NASTY)], CHATS)
    assert chat_format.formatted(df).first().formatted == "[INST] a[NEXT]b [/INST]<s>c[NEXT]<\\/s>[\\INST] ok [\\/INST]</s>"


DOCS = "doc_id long, text string, shard string"


def test_shards_are_even_and_gapless(spark, tmp_path):
    docs = [(i, "é" * (i * 37 % 400), "x") for i in range(700)] + [(5000, "y" * 3000, None), (None, None, "s"), (None, "", "s"), (7, "dup", ""), (7, "dup", "")]
    df = spark.createDataFrame(docs, DOCS)
    got = virtual_slots.op8(spark, df, f"file://{tmp_path}/map").collect()
    assert len(got) == len(docs)
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    loads, places = defaultdict(int), defaultdict(list)
    for r in got:
        loads[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert set(loads) == set(range(16))
    assert max(loads.values()) - min(loads.values()) <= 0.05 * sum(loads.values()) / 16
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_shards_of_nothing(spark, tmp_path):
    assert virtual_slots.op8(spark, spark.createDataFrame([], DOCS), f"file://{tmp_path}/map").count() == 0


def test_rebalance_moves_only_to_new_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "z" * (i % 90), "") for i in range(3000)], DOCS)
    first = virtual_slots.store_map(virtual_slots.first_map(virtual_slots.slot_loads(virtual_slots.placed(df)), 4096, 16), f"file://{tmp_path}/map")
    second = virtual_slots.store_map(virtual_slots.rebalanced(first, 16, 17), f"file://{tmp_path}/map")
    before = {r.virtual_slot: r for r in first.collect()}
    after = {r.virtual_slot: r for r in second.collect()}
    assert {r.version for r in before.values()} == {1} and {r.version for r in after.values()} == {2}
    assert all(r.shard in (before[s].shard, 16) for s, r in after.items())
    loads = defaultdict(int)
    for r in after.values():
        loads[r.shard] += r.bytes
    assert max(loads.values()) <= 1.1 * sum(loads.values()) / 17
    assert min(loads.values()) >= 0.85 * sum(loads.values()) / 17


def test_a_version_stored_twice_has_each_slot_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(100)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    once = virtual_slots.shard_table(df, path).collect()
    again = virtual_slots.shard_table(df, path).collect()
    assert len(once) == len(again) == 100 and sorted(once) == sorted(again)
    assert spark.read.parquet(path).count() == virtual_slots.SLOTS


def test_long_chats_and_running_lengths(spark):
    long = "word </s> " * 60_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, "assistant" if i % 5 else "user", f"t{i} \\") for i in range(3000)]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(spark.createDataFrame(turns, CHATS))).collect()}
    for conv in (1, 2):
        loss = "".join(t[3] for t in turns if t[0] == conv and t[2] == "assistant")
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].n_turns == sum(t[0] == conv for t in turns)
    sizes = [3, 0, 5] * 300
    row = spark.createDataFrame([(sizes,), ([],), ([7],)], "n array<bigint>").select(chat_format.running(chat_format.F.col("n")).alias("upto")).collect()
    assert [r.upto for r in row] == [[sum(sizes[:i]) for i in range(900)], [], [0]]
