"""Chat formatting with typed content parts.

A turn is a list of parts: text, or an image, audio clip or document that stands
for a number of tokens. The visitor renders the parts in order; what is not text
becomes a placeholder, its reference and expanded token count are recorded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import running_totals

#: A content part. ``text`` is set for text, ``ref`` and sizes for the others.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Fixed values of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Fixed: placeholder per type of part.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings with a meaning for a model: any ``<|``, and the marks of two common
#: templates. Escaping puts a backslash after the first character, on top of
#: those that are there, so it can be undone whatever the text holds.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\]|</?SYS>>)"

#: Turns per segment.
SEGMENT_TURNS = 64
#: Side of an image patch, tokens per second of audio and per page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def expanded_tokens(part: Column) -> Column:
    """Tokens that stand for a part that is not text; 0 for unknown sizes."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    audio = F.ceil(part["seconds"] * AUDIO_RATE)
    known = F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", part["pages"] * PAGE_TOKENS)
    return F.coalesce(known, F.lit(0)).cast("long")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text; a null text is empty."""
    fields = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return F.array(fields)


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["type"].isin(list(PLACEHOLDERS)), F.lit(False))


def joined_text_parts(parts: Column) -> Column:
    """The parts with neighbouring texts joined, so that a control string cannot
    be put together from parts that are harmless each."""

    def starts(i: Column) -> Column:
        return ~_is_text(F.get(parts, i)) | ~F.coalesce(_is_text(F.get(parts, i - 1)), F.lit(False)) | (i == 0)

    first = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), starts)
    group = F.zip_with(first, F.slice(first, 2, F.size(parts)), lambda i, end: F.slice(parts, i + 1, F.coalesce(end, F.size(parts)) - i))

    def merged(group: Column) -> Column:
        text = F.array_join(F.transform(group, lambda part: F.coalesce(part["text"], F.lit(""))), "")
        return F.when(_is_text(group[0]), F.get(text_part(text), 0)).otherwise(group[0])

    return F.when(F.size(parts) > 1, F.transform(group, merged)).otherwise(parts)


def _piece(string: Column, masked: Column) -> Column:
    return F.struct(string.alias("string"), masked.alias("loss"))


def _visit(part: Column, role: Column, loss_role: str) -> Column:
    """Rendered part, and whether it is trained on."""
    placeholder = reduce(lambda c, kind: c.when(part["type"] == kind, F.lit(PLACEHOLDERS[kind])), PLACEHOLDERS, F.when(F.lit(False), F.lit("")))
    rendered = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)
    return _piece(rendered, _is_text(part) & (role == loss_role))


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant"
) -> DataFrame:
    """Segments of formatted conversations.

    Returns ``conversation, segment, formatted, loss, attachments,
    expanded_tokens``: the segments of a conversation in order of ``segment``
    (a null first) are its formatted text. ``loss`` lists the spans under the
    loss mask as code point offsets into the segment, end exclusive; only text
    parts of ``loss_role`` are in it. ``attachments`` lists type, reference and
    tokens of the placeholders in order. A segment holds a range of turn
    numbers, so a conversation of any length is rendered in pieces. Neighbouring
    text parts are one text, escaped as a whole.

    Turns are ordered by number (null first), role, then content; repeated rows
    are repeated turns. A null role or text is the empty string, parts of an
    unknown type are text, a null list of parts has none. Other columns are not
    looked at, and an empty table gives no segments.
    """
    said = turns.select(
        F.col(conversation).alias("conversation"),
        F.floor(F.col(turn) / SEGMENT_TURNS).alias("segment"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
        ).alias("said"),
    )
    segments = said.groupBy("conversation", "segment").agg(F.array_sort(F.collect_list("said")).alias("said"))

    def pieces(one: Column) -> Column:
        head = _piece(F.concat(F.lit(TURN), escape(one["role"]), F.lit(TEXT)), F.lit(False))
        body = F.transform(joined_text_parts(one["parts"]), lambda part: _visit(part, one["role"], loss_role))
        return F.concat(F.array(head), body, F.array(_piece(F.lit(END), F.lit(False))))

    def masked(piece: Column, end: Column) -> Column:
        return F.when(piece["loss"], F.struct((end - F.length(piece["string"])).alias("start"), end.alias("end")))

    ends = running_totals(F.transform("pieces", lambda piece: F.length(piece["string"])))
    attachments = F.transform(
        F.filter(F.flatten(F.col("said.parts")), lambda part: ~_is_text(part)),
        lambda part: F.struct(part["type"].alias("type"), part["ref"].alias("ref"), expanded_tokens(part).alias("tokens")),
    )
    rendered = segments.select("conversation", "segment", F.flatten(F.transform("said", pieces)).alias("pieces"), attachments.alias("attachments"))
    return rendered.select(
        F.col("conversation").alias(conversation),
        "segment",
        F.array_join("pieces.string", "").alias("formatted"),
        F.array_compact(F.zip_with("pieces", ends, masked)).alias("loss"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, one: total + one["tokens"]).alias("expanded_tokens"),
    )


def read_back(segments: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Turns and masked texts of formatted segments, per conversation.

    Returns ``conversation, n_turns, turns, loss, formatted_chars``: ``turns`` is
    role, line end, text, line end per turn, ``loss`` all text under the mask,
    both unescaped. Only what the segments hold is used.
    """
    turns = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda one, i: i > 0)
    lines = F.transform(turns, lambda one: F.split(one, r"<\|text\|>|<\|end\|>", -1))
    spoken = F.transform(lines, lambda fields: F.concat(unescape(fields[0]), F.lit("\n"), unescape(fields[1]), F.lit("\n")))
    masked = F.transform("loss", lambda span: unescape(F.substring(F.col("formatted"), span["start"] + 1, span["end"] - span["start"])))
    read = segments.select(
        F.col(conversation),
        F.size(turns).cast("long").alias("n_turns"),
        F.length("formatted").cast("long").alias("n_chars"),
        F.struct("segment", F.array_join(spoken, "").alias("turns"), F.array_join(masked, "").alias("loss")).alias("read"),
    )
    joined = read.groupBy(conversation).agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.array_sort(F.collect_list("read")).alias("read")
    )
    return joined.select(
        conversation, "n_turns", F.array_join("read.turns", "").alias("turns"), F.array_join("read.loss", "").alias("loss"), "formatted_chars"
    )
