"""Chat formatting with typed content parts.

A turn's content is a list of parts. The visitor turns each part, in order, into text: a text part into its escaped
text, an image, audio or document part into a numbered placeholder, for which it records the attachment's reference
and how many tokens the placeholder expands to. A formatted turn is ``<s>[INST] role [/INST]content</s>``.

Escaping is reversible and leaves no control string in texts or roles: a backslash becomes two, and the first
character of a control string becomes ``\\l`` (for ``<``) or ``\\b`` (for ``[``). That of a control string's beginning at
the end of a text does, too, since the next part may go on with it.

Null texts, roles and part lists count as empty; an unknown part type is an error that names it. Turns are ordered by
turn (nulls first), then role and text, so repeated turns have a place. A row with a null conversation id is a
conversation of its own. Formatting works row by row and takes texts of any length; only the fold over a
conversation's turns needs them together, and it streams over sorted partitions, so no conversation is ever held in
memory. Columns of the outputs' names are replaced, others stay with ``format_turns``. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import read, replacing, tidy

#: A content part. width, height (pixels), seconds and pages are of images, audio and documents.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens: an image takes one per patch, audio so many a second, a document so many a page; unknown sizes take the default.
PATCH, AUDIO_RATE, PAGE_TOKENS, DEFAULT_TOKENS = 28, 25, 512, 256
CONTROL_ANGLE = r"<(?=/?s>|\||/?s?\z)"
CONTROL_BRACKET = r"\[(?=/?INST\]|/?(?:I(?:N(?:ST?)?)?)?\z)"
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {"\\": "\\", "l": "<", "b": "["}


def escape(text: Column) -> Column:
    whole = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(whole, CONTROL_ANGLE, r"\\l"), CONTROL_BRACKET, r"\\b")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def text_part(text: Column) -> Column:
    """The parts column of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def part_tokens(p: Column) -> Column:
    image = (F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH)).cast("long")
    audio = F.ceil(p["seconds"] * AUDIO_RATE).cast("long")
    document = (p["pages"] * PAGE_TOKENS).cast("long")
    known = F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).when(p["type"] == "document", document)
    return F.coalesce(known, F.lit(DEFAULT_TOKENS).cast("long"))


def visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments: array<struct<index, type, uri, tokens>>) of a parts column."""
    kinds = ("image", "audio", "document")
    empty = F.struct(F.lit("").alias("content"), F.array().cast("array<struct<index:int,type:string,uri:string,tokens:bigint>>").alias("attachments"))

    def step(s: Column, p: Column) -> Column:
        n = F.size(s["attachments"]) + 1
        holder = F.concat(F.lit("<|"), p["type"], F.lit(":"), n.cast("string"), F.lit("|>"))
        more = F.array(F.struct(n.alias("index"), p["type"].alias("type"), p["uri"].alias("uri"), part_tokens(p).alias("tokens")))
        said = F.when(p["type"] == "text", escape(p["text"])).when(p["type"].isin(*kinds), holder).otherwise(F.raise_error(F.concat(F.lit("unknown part type "), F.coalesce(p["type"], F.lit("null")))))
        return F.struct(F.concat(s["content"], said).alias("content"), F.when(p["type"].isin(*kinds), F.concat(s["attachments"], more)).otherwise(s["attachments"]).alias("attachments"))

    folded = F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), empty, step)
    return folded["content"], folded["attachments"]


def format_turns(df: DataFrame, role: str = "role", parts: str = "parts") -> DataFrame:
    """Adds formatted (the turn's text), attachments and attachment_tokens, in the place of columns of these names."""
    df = replacing(df, ["formatted", "attachments", "attachment_tokens"])
    content, attachments = visit(F.col(parts))
    formatted = F.concat(F.lit("<s>[INST] "), escape(F.col(role)), F.lit(" [/INST]"), content, F.lit("</s>"))
    return df.withColumns({"formatted": formatted, "attachments": attachments}).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


class Reader:
    """Reads a formatted conversation back, piece by piece: turns, and the text under the loss mask (what assistants say)."""

    def __init__(self) -> None:
        self.rest, self.turns, self.formatted, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.formatted += len(piece)
        self.rest += piece
        at = 0
        while found := TURN.match(self.rest, at):
            role, text = unescape(found[1]), unescape(found[2])
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode())
            at = found.end()
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("a formatted conversation ends inside a turn")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


SUMMARY = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long"


def summarise(turns: DataFrame, conversation: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "formatted")) -> DataFrame:
    """One row per conversation, read back from its formatted turns: counts and digests of all turns and of the text under the loss mask."""
    kind = turns.schema[conversation].dataType.simpleString()
    solo = F.when(F.col(conversation).isNull(), F.monotonically_increasing_id())
    names = [conversation, *(x.split()[0] for x in SUMMARY.split(", "))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, tokens, rows = None, None, 0, []
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for own, piece, more, alone in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if reader is None or (own, alone) != key:
                    if reader is not None:
                        rows.append((key[0], *reader.row(), tokens))
                    key, reader, tokens = (own, alone), Reader(), 0
                reader.feed(piece)
                tokens += more
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key[0], *reader.row(), tokens), kinds, strict=True)], names=names)

    dealt = turns.withColumn("_solo", solo).repartition(conversation, "_solo").sortWithinPartitions(conversation, "_solo", *order)
    return dealt.select(conversation, "formatted", "attachment_tokens", "_solo").mapInArrow(tidy(fold), f"`{conversation}` {kind}, {SUMMARY}")


def conversations_text(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conversation, formatted: the whole text of each conversation, for writing; a conversation must fit in one row."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("role"), F.col("formatted"))))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(listed, lambda x: x["formatted"]), "").alias("formatted"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return summarise(format_turns(rows.withColumn("parts", text_part(F.col("text")))).drop("parts", "text")).drop("attachment_tokens")
