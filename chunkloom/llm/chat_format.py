"""Chat formatting with typed content parts.

A turn holds an ordered array of parts (text, image, audio, document). A
visitor flattens them: text is escaped, any other part becomes a placeholder
in its place, and its reference is recorded with the tokens the placeholder
stands for. Everything is a DataFrame expression.

Escaping is reversible: a backslash is doubled, and a backslash is put behind
the first character of every control string that a text or role contains.
After that no control string can occur inside a turn, and ``unescape`` drops
one backslash from each pair.

Defined results: a null role, text or part list counts as empty; an unknown
kind of part counts as a document; turns are ordered by (turn, role, text)
with nulls first, and repeated rows stay, each as a turn of its own; an empty
table gives an empty result; other columns are ignored. A conversation is one
output value, so its turns meet in one task by nature of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class ChatTemplate:
    """Markers of a turn, control strings to escape, and what a placeholder expands to."""

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    #: ``<|`` opens every marker and placeholder of this template; the others belong to common chat formats.
    control: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    image_patch: int = 28
    audio_tokens_per_second: int = 25
    document_tokens_per_page: int = 256

    def __post_init__(self) -> None:
        for marker in (self.turn, self.body, self.end):
            if not marker.startswith("<|") or "\\" in marker:
                raise ValueError("markers start with <| and hold no backslash")
        if "<|" not in self.control or any("\\" in c or not c for c in self.control):
            raise ValueError("control strings include <| and hold no backslash")

    def escape(self, text: Column) -> Column:
        hits = "|".join(re.escape(c) for c in self.control)
        doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
        return F.regexp_replace(doubled, f"(?s)(?=(?:{hits}))(.)", "$1\\\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, "(?s)\\\\(.)", "$1")

    def tokens(self, part: Column) -> Column:
        """Tokens that a placeholder expands to; unknown sizes count as one unit."""
        patches = lambda side: F.ceil(F.greatest(F.coalesce(part[side], F.lit(1)), F.lit(1)) / F.lit(self.image_patch))
        return (
            F.when(part["kind"] == "text", F.lit(0))
            .when(part["kind"] == "image", patches("width") * patches("height"))
            .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * self.audio_tokens_per_second))
            .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.document_tokens_per_page)
            .cast("long")
        )


def text_parts(text: Column) -> Column:
    """The part list of a turn that holds text alone."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(PARTS)


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, turn, role, parts) -> one row per conversation.

    Returns conv_id, n_turns, formatted, loss_spans (array of start and length
    in code points of ``formatted``: the contents of turns under the loss),
    attachments (array of turn position, part position, kind, ref, tokens) and
    attachment_tokens.
    """
    t = template
    kind = lambda p: F.when(p["kind"].isin("text", "image", "audio", "document"), p["kind"]).otherwise(F.lit("document"))
    parts = F.transform(F.coalesce(F.col("parts"), F.array().cast(PARTS)), lambda p, i: F.struct(kind(p).alias("kind"), p["text"].alias("text"), p["ref"].alias("ref"), p["width"].alias("width"), p["height"].alias("height"), p["seconds"].alias("seconds"), p["pages"].alias("pages"), i.alias("part")))
    visited = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("p"))
    content = F.array_join(F.transform("p", lambda p: F.when(p["kind"] == "text", t.escape(p["text"])).otherwise(F.concat(F.lit("<|"), p["kind"], F.lit(":"), p["part"].cast("string"), F.lit("|>")))), "")
    visited = visited.select(
        "conv_id", "turn", "role", content.alias("content"), F.concat(F.lit(t.turn), t.escape(F.col("role")), F.lit(t.body)).alias("head"),
        F.transform(F.filter("p", lambda p: p["kind"] != "text"), lambda p: F.struct(p["part"].alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), t.tokens(p).alias("tokens"))).alias("att"),
    )
    length = F.char_length("head") + F.char_length("content") + F.lit(len(t.end))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    placed = visited.select("*", F.coalesce(F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "role", "head", "content", "att"))).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r, i: F.transform(r["att"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    spans = F.transform(F.filter("rows", lambda r: r["role"].isin(*t.loss_roles)), lambda r: F.struct((r["start"] + F.char_length(r["head"])).alias("start"), F.char_length(r["content"]).cast("long").alias("length")))
    out = rows.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"), F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["content"], F.lit(t.end))), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The (role, text) of every turn, parsed from a formatted conversation."""
    t = template
    pieces = F.split(formatted, re.escape(t.turn))
    return F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda s: F.struct(t.unescape(F.substring_index(s, t.body, 1)).alias("role"), t.unescape(F.substring_index(F.substring_index(s, t.body, -1), t.end, 1)).alias("text")),
    )


def loss_text(formatted: Column, spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
