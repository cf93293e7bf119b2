r"""Chat formatting with typed content parts (operator 1), in DataFrame functions only.

A conversation is a set of rows (conversation, turn, role, content). Content is a text or an array of typed parts;
flatten_parts visits the parts in order and turns each attachment into a placeholder, while its reference and the
tokens it expands to are recorded beside the text. The template is

    <turn ROLE>\nCONTENT</turn>\n        attachments inside CONTENT: <image>, <audio>, <document>

and the escape is reversible: `\` is written `\b`, `<` is written `\l`, `>` is written `\g`, so no text can hold a
template mark. Loss covers the content of loss_roles; spans are code points of `formatted`.

Cases: null text or null parts count as empty; a null role counts as the empty role; turns are ordered by turn, ties
by role, then content (repeated rows stay repeated), null turns first; a null conversation id is a conversation of its
own; a very long text is one string as any other (up to Spark's 2 GB a row); an empty table gives an empty result; extra columns
are ignored, whatever their names. All turns of one conversation meet in one row,
since its text is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type of one content part; size is width * height for images, seconds for audio, pages for documents.
PART = "struct<kind: string, text: string, uri: string, size: double>"
#: Default tokens per unit of size: one per 28 x 28 pixels, 25 per second, 600 per page.
TOKENS_PER_UNIT = {"image": 1 / 784, "audio": 25.0, "document": 600.0}
HEAD, CLOSE, TAIL = "<turn ", "</turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a one-part content."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("size"))).cast(f"array<{PART}>")


def flatten_parts(parts: Column, tokens_per_unit: dict[str, float] = TOKENS_PER_UNIT) -> Column:
    """struct(content, attachments): escaped text with placeholders in order, and (kind, uri, tokens) per placeholder.
    A part of another kind gives its text only."""

    def visit(part: Column) -> Column:
        shown = escape(F.coalesce(part["text"], F.lit("")))
        for kind in tokens_per_unit:
            shown = F.when(part["kind"] == kind, F.lit(f"<{kind}>")).otherwise(shown)
        return shown

    def reference(part: Column) -> Column:
        tokens = F.lit(0)
        for kind, rate in tokens_per_unit.items():
            tokens = F.when(part["kind"] == kind, F.ceil(F.coalesce(part["size"], F.lit(0.0)) * rate)).otherwise(tokens)
        return F.struct(part["kind"].alias("kind"), part["uri"].alias("uri"), tokens.cast("bigint").alias("tokens"))

    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    attached = F.filter(parts, lambda p: p["kind"].isin(list(tokens_per_unit)))
    return F.struct(F.array_join(F.transform(parts, visit), "").alias("content"), F.transform(attached, reference).alias("attachments"))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_roles: tuple[str, ...] = ("assistant",), tokens_per_unit: dict[str, float] = TOKENS_PER_UNIT) -> DataFrame:
    """One row per conversation: id, formatted, loss_spans (array of start, end), attachments (array of kind, uri,
    tokens, in placeholder order) and attachment_tokens."""
    parts = F.col(parts_col) if parts_col else text_parts(F.col(text_col))
    flat = flatten_parts(parts, tokens_per_unit)
    turns = rows.select(F.col(id_col).alias("_id"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), flat.alias("_flat"))
    row = F.struct("_turn", "_role", F.col("_flat.content").alias("content"), F.col("_flat.attachments").alias("attachments"))
    grouped = turns.groupBy("_id").agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    # Alternating pieces: mark, content, mark, content, ..., closing mark.
    head = lambda t: F.concat(F.lit(HEAD), escape(t["_role"]), F.lit(">\n"))
    piece = lambda t: F.concat(head(t), t["content"], F.lit(TAIL))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))
    sized = F.transform("_turns", lambda t: F.struct(F.length(head(t)).cast("bigint").alias("h"), F.length(t["content"]).cast("bigint").alias("c"), t["_role"].isin(list(loss_roles)).alias("loss")))
    # Where each turn's content begins, as a running sum.
    walk = F.aggregate(
        sized,
        start,
        lambda acc, t: F.struct(
            (acc["at"] + t["h"] + t["c"] + len(TAIL)).alias("at"),
            F.when(t["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + t["h"]).alias("start"), (acc["at"] + t["h"] + t["c"]).alias("end")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    attachments = F.flatten(F.transform("_turns", lambda t: t["attachments"]))
    return grouped.select(
        F.col("_id").alias(id_col),
        F.array_join(F.transform("_turns", piece), "").alias("formatted"),
        walk["spans"].alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped."""
    pieces = F.filter(F.split(formatted, f"{CLOSE}\n"), lambda p: p != "")
    body = lambda p: F.substr(p, F.instr(p, ">\n") + 2)
    role = lambda p: F.substr(p, F.lit(len(HEAD) + 1), F.instr(p, ">\n") - 1 - len(HEAD))
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
