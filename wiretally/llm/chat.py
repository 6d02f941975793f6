r"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A turn is written ``<s>role\ntext\n</s>``. Control strings inside a text get one
more backslash in front than they had, so a marker without one is always the
template's own, and taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "\n</s>"
ASSISTANT = "assistant"

# The control strings that texts may not bring in.
CONTROL = r"(</?s>|\[/?INST\])"
# Characters that a role is written without, and what stands for them.
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*){CONTROL}", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*){CONTROL}", "$1$2")


def _role_written(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_read(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def examples(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(conv_id, example_no, of, formatted, loss_start, loss_end)``, one row per example.

    Every assistant turn becomes an example: all turns up to it, of which only
    its escaped text, code points ``loss_start`` to ``loss_end`` (exclusive), is
    trainable. If a conversation does not end with an assistant turn, a last
    example without a trainable part holds the whole of it. Turns are ordered by
    turn number, null first, then role, then text; null roles and texts count as
    empty; repeated rows are turns of their own; a null id is a conversation.

    A conversation is one training text, so it is gathered into one row; its
    examples are built one by one, never together.
    """
    empty = F.lit("")
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(role, empty).alias("role"),
            F.coalesce(text, empty).alias("text"),
        ).alias("entry"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    written = lambda e: F.concat(
        F.lit(OPEN), _role_written(e["role"]), F.lit("\n"), escaped(e["text"]), F.lit(CLOSE)
    )
    n = F.size("entries")
    replies = F.filter(
        F.sequence(F.lit(1), n), lambda i: F.element_at("entries", i)["role"] == ASSISTANT
    )
    tail = F.when(F.element_at("entries", -1)["role"] == ASSISTANT, F.array().cast("array<int>"))
    ends = F.concat(replies, tail.otherwise(F.array(n)))
    whole = whole.select("conv_id", F.transform("entries", written).alias("parts"), "entries", ends.alias("ends"))
    each = whole.select(
        "conv_id",
        "parts",
        "entries",
        F.size("ends").alias("of"),
        F.posexplode("ends").alias("example_no", "end"),
    )
    last = F.element_at("entries", F.col("end"))
    return each.select(
        "conv_id",
        (F.col("example_no") + 1).alias("example_no"),
        "of",
        F.array_join(F.slice("parts", F.lit(1), F.col("end")), "").alias("formatted"),
        F.when(last["role"] == ASSISTANT, F.length(escaped(last["text"]))).otherwise(0).alias("loss"),
    ).select(
        "conv_id",
        "example_no",
        "of",
        "formatted",
        (F.length("formatted") - len(CLOSE) - F.col("loss")).alias("loss_start"),
        (F.length("formatted") - len(CLOSE)).alias("loss_end"),
    )


def turns_of(formatted: Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted example."""
    pieces = F.split(formatted, r"(?<!\\)</s>", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def read(piece: Column) -> Column:
        at = F.locate("\n", piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(piece, at + 1, F.length(piece) - at - 1)
        return F.struct(_role_read(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, read)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text, as it was before escaping."""
    return unescaped(F.substring(formatted, start + 1, end - start))


def read_back(formatted: DataFrame) -> DataFrame:
    """Facts per conversation, from the examples alone.

    Turns come from the last example, which holds all of them; the trainable
    text is that of all examples in order.
    """
    turns = F.when(F.col("example_no") == F.col("of"), turns_of(F.col("formatted")))
    rows = formatted.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        turns.alias("turns"),
        F.struct(
            "example_no", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")
        ).alias("loss"),
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    rows = rows.select(
        "conv_id",
        "chars",
        "loss",
        F.size("turns").cast("long").alias("n"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("sha"),
    )
    found = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), ""
        ).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
