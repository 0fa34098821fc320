"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged into
one block, and blocks are concatenated:

    <|turn|>role\\n text (<|next|> text)* <|end|>\\n

``<|next|>`` parts the merged turns, so each of them can be read back. Control strings inside texts
and roles (this template's and those of other common templates) are escaped: the first character of
such a string becomes an entity, and so does an ampersand that would read as one. Everything else
stays as it is, and unescaping gives back the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The template's control strings. All begin with "<|", which never stands in an escaped text.
TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"

# What marks control strings in this and other public chat templates.
_ANGLE = r"<(?=\||/?s>|/?bos>|/?eos>|/?start_of_turn>|/?end_of_turn>|<SYS>>|</SYS>>)"
_SQUARE = r"\[(?=/?INST\]|/?SYSTEM_PROMPT\]|/?AVAILABLE_TOOLS\]|/?TOOL_CALLS\]|/?TOOL_RESULTS\])"
_AMPERSAND = r"&(?=amp;|lt;|lb;|nl;)"


def escaped(text: Column) -> Column:
    """text with its control strings made harmless; null as empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _AMPERSAND, "&amp;")
    return F.regexp_replace(F.regexp_replace(out, _ANGLE, "&lt;"), _SQUARE, "&lb;")


def escaped_role(role: Column) -> Column:
    """A role as it stands in a header: escaped, and on one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def unescaped(text: Column) -> Column:
    """What ``escaped`` or ``escaped_role`` was given."""
    out = text
    for entity, char in (("&lt;", "<"), ("&lb;", "["), ("&nl;", "\n"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def _blocks(turns: Column) -> Column:
    """Sorted turns as an array of (role, texts), one for each run of one role."""
    n = F.size(turns)

    def of(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, k: F.struct(
                F.get(turns, s)["role"].alias("role"),
                F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), n) - s), lambda t: t["text"]).alias("texts"),
            ),
        )

    # positions where a run begins: the role differs from that of the turn before
    begins = F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i))
    return let(F.array_compact(begins), of)


#: Strings of a conversation that are measured together; starts are summed within such a part, then over parts.
PART = 64
_PART_TYPE = "struct<chars:bigint,bytes:bigint,spans:array<struct<start:bigint,length:bigint,first_byte:bigint,bytes:bigint>>>"


def _measured(part: Column) -> Column:
    """Characters and bytes of a few strings, and the spans of the learned ones among them."""

    def further(acc: Column, p: Column) -> Column:
        chars, size = F.char_length(p["s"]).cast("long"), F.octet_length(p["s"]).cast("long")
        span = F.struct(acc["chars"].alias("start"), chars.alias("length"), acc["bytes"].alias("first_byte"), size.alias("bytes"))
        spans = F.when(p["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["chars"] + chars).alias("chars"), (acc["bytes"] + size).alias("bytes"), spans.alias("spans"))

    return F.aggregate(part, F.from_json(F.lit('{"chars":0,"bytes":0,"spans":[]}'), _PART_TYPE), further)


def _spans(pieces: Column) -> Column:
    """(start, length, first_byte, bytes) of the learned strings in the whole, counted from 0.

    Each part's strings are folded by themselves, then the parts' lengths; a fold copies what it has found,
    so folding all strings at once would cost the square of their number.
    """
    parts = F.transform(
        F.sequence(F.lit(0), (F.size(pieces) / PART).cast("int")), lambda k: _measured(F.slice(pieces, k * PART + 1, F.lit(PART)))
    )
    zero = F.array(F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("bytes")))
    last = lambda acc: F.element_at(acc, -1)

    def shifted(measured: Column) -> Column:
        begins = F.aggregate(
            measured,
            zero,
            lambda acc, m: F.concat(
                acc, F.array(F.struct((last(acc)["chars"] + m["chars"]).alias("chars"), (last(acc)["bytes"] + m["bytes"]).alias("bytes")))
            ),
        )
        moved = lambda begin: lambda s: F.struct(
            (s["start"] + begin["chars"]).alias("start"), s["length"].alias("length"),
            (s["first_byte"] + begin["bytes"]).alias("first_byte"), s["bytes"].alias("bytes"),
        )
        return let(begins, lambda at: F.flatten(F.transform(measured, lambda m, k: F.transform(m["spans"], moved(F.get(at, k))))))

    return let(parts, shifted)


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``.

    loss_spans holds structs, one for each text of the learned role, in order: start and length in code
    points of ``formatted``, first_byte and bytes in its UTF-8 form, counted from 0. Turns are ordered by
    turn (null first), equal ones by role and text, so repeated rows and ties give one defined result; a
    null role is the empty role, a null text the empty text, a null conversation id is a conversation.
    Other columns are ignored. An empty table gives no rows. A conversation is one output row, so its
    turns meet in one task; the work on them is near linear in their number.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        escaped_role(F.col(role)).alias("role"),
        escaped(F.col(text)).alias("text"),
    )
    blocks = turns.groupBy(conversation).agg(_blocks_of(one).alias("_blocks"))
    # every block as its strings in order: header, text, NEXT, text, ..., END
    pieces = F.flatten(
        F.transform(
            F.col("_blocks"),
            lambda b: F.concat(
                F.array(F.struct(F.concat(F.lit(TURN), b["role"], F.lit("\n")).alias("s"), F.lit(False).alias("learned"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, k: F.array(
                            F.struct(F.when(k == 0, F.lit("")).otherwise(F.lit(NEXT)).alias("s"), F.lit(False).alias("learned")),
                            F.struct(t.alias("s"), (b["role"] == learned_role).alias("learned")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("learned"))),
            ),
        )
    )
    with_pieces = blocks.select(conversation, pieces.alias("_pieces"))
    return with_pieces.select(
        conversation,
        F.concat_ws("", F.transform("_pieces", lambda p: p["s"])).alias("formatted"),
        let(F.col("_pieces"), _spans).alias("loss_spans"),
    )


def _blocks_of(one: Column) -> Column:
    return let(F.sort_array(F.collect_list(one)), _blocks)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text), unescaped."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.char_length(formatted))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(
                    F.substring(b, F.locate("\n", b) + 1, F.char_length(b) - F.locate("\n", b) - len(END)),
                    r"<\|next\|>",
                ),
                lambda t: F.struct(
                    unescaped(F.substring_index(b, "\n", 1)).alias("role"), unescaped(t).alias("text")
                ),
            ),
        )
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, joined with nothing between; cut by bytes, so no span is searched for."""
    return let(
        formatted.cast("binary"),
        lambda raw: F.concat_ws(
            "",
            F.transform(
                spans, lambda s: unescaped(F.substring(raw, (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))
            ),
        ),
    )
