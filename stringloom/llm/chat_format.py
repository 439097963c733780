"""Chat formatting as relational expressions.

The turns of a conversation are collected as structs and sorted (by turn, then by role and text for equal turn numbers).  In the
sorted array neighbouring turns of one role are merged into one block, the blocks become strings, and these are concatenated.
Running lengths are added up in pieces of the array, so the work does not grow with the square of a conversation's turns.

Template.  user: `[INST] a [/INST]`; system: `[SYS] a [/SYS]`; assistant: `<s>a</s>`; any other role:
`[ROLE]name[/ROLE]a</s>`.  Turns merged into one block are parted by `[NEXT]`.  Inside texts and role names a backslash
becomes two and a control string gets a backslash after its first character, so no control string is left in them and
`unescaped` gives the exact text back.

Loss mask.  `loss_spans` holds (start, length) in code points of the output for each assistant text, in order.  Marks and
`[NEXT]` are never in it.

Defined results: null text is empty; a null role is the empty role name; null conversation ids form one conversation; equal
turn numbers are ordered by role and text; repeated rows are repeated turns; no rows give no conversations; further columns
are ignored.  A conversation is one output value, so its turns meet in one task, as that value must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROL = r"(<|\[)(/?(?:s>|INST\]|SYS\]|ROLE\])|NEXT\])"
BLOCK = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\].*?</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, user: Column, system: Column, assistant: Column, other: Column) -> Column:
    return F.when(role == "user", user).when(role == "system", system).when(role == "assistant", assistant).otherwise(other)


#: Elements of a piece of an array whose lengths are added up one after another.
PIECE = 256


def _upto(lengths: Column, first: Column) -> Column:
    """`first` plus the sum of the elements before each one, in one pass that copies what it has found so far."""
    start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("found"))
    step = lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["found"], F.array(state["at"])).alias("found"))
    return F.aggregate(lengths, start, step)["found"]


def running(lengths: Column) -> Column:
    """Sum of the elements before each one of an array of longs."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PIECE).cast("int")), lambda i: F.slice(lengths, i * PIECE + 1, F.lit(PIECE)))
    firsts = _upto(F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0).cast("long"))
    return F.when(F.size(lengths) > 0, F.flatten(F.zip_with(pieces, firsts, _upto))).otherwise(F.array().cast("array<bigint>"))


def formatted(turns: DataFrame) -> DataFrame:
    """`conv_id, formatted, loss_spans` for each conversation of `turns(conv_id, turn, role, text)`."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.withColumns({"roles": F.col("turns.role"), "bodies": F.transform("turns", lambda t: escaped(t["text"]))}).drop("turns")
    # a block begins where the role is another one than before
    begins = F.filter(F.sequence(F.lit(0), F.size("roles") - 1), lambda i: (i == 0) | (F.get("roles", i - 1) != F.get("roles", i)))
    rows = rows.withColumn("begins", begins)
    until = lambda k: F.coalesce(F.get("begins", k + 1), F.size("roles"))
    block = lambda i, k: F.struct(F.get("roles", i).alias("role"), F.slice("bodies", i + 1, until(k) - i).alias("bodies"))
    rows = rows.withColumn("blocks", F.transform("begins", block))

    def spelled(block: Column) -> Column:
        role = block["role"]
        name = F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[/ROLE]"))
        head = _by_role(role, F.lit("[INST] "), F.lit("[SYS] "), F.lit("<s>"), name)
        tail = _by_role(role, F.lit(" [/INST]"), F.lit(" [/SYS]"), F.lit("</s>"), F.lit("</s>"))
        return F.concat(head, F.array_join(block["bodies"], "[NEXT]"), tail)

    rows = rows.withColumn("pieces", F.transform("blocks", spelled))
    rows = rows.withColumn("starts", running(F.transform("pieces", lambda p: F.length(p).cast("long"))))

    def spans(block: Column, start: Column) -> Column:
        lengths = F.transform(block["bodies"], lambda b: F.length(b).cast("long"))
        before = running(F.transform(lengths, lambda n: n + len("[NEXT]")))
        return F.zip_with(before, lengths, lambda at, n: F.struct((start + len("<s>") + at).alias("start"), n.alias("length")))

    said = F.filter(F.arrays_zip("blocks", "starts"), lambda b: b["blocks"]["role"] == "assistant")
    return rows.select("conv_id", F.array_join("pieces", "").alias("formatted"), F.flatten(F.transform(said, lambda b: spans(b["blocks"], b["starts"]))).alias("loss_spans"))


def parsed(chats: DataFrame) -> DataFrame:
    """Read `formatted` back: adds `turns`, an array of (role, text) with the merged turns apart again, and `loss_text`, the
    unescaped text under the loss mask."""

    def opened(block: Column) -> Column:
        plain, system, assistant = block.startswith("[INST] "), block.startswith("[SYS] "), block.startswith("<s>")
        role = F.when(plain, "user").when(system, "system").when(assistant, "assistant").otherwise(unescaped(F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)))
        body = F.regexp_replace(block, r"(?s)^(?:\[INST\] |\[SYS\] |<s>|\[ROLE\].*?\[/ROLE\])|(?: \[/INST\]| \[/SYS\]|</s>)\z", "")
        return F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    turns = F.flatten(F.transform(F.regexp_extract_all("formatted", F.lit(BLOCK), F.lit(0)), opened))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.withColumns({"turns": turns, "loss_text": loss})


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns, all taken from what `parsed` read back out of the formatted text."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
