"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of typed parts. The visitor maps every part to a piece of the turn's
content: a text part to its escaped text, an image, audio or document part to an ordered
placeholder, whose reference and expanded token count are recorded as an attachment.

Template: ``<|im_start|>`` role ``<|im_sep|>`` content ``<|im_end|>`` per turn.
Escaping: in roles and texts every ``<``, n backslashes, ``|`` gets one backslash more, so no
escaped text holds ``<|``; unescaping takes that backslash off again.

Defined cases: a null text, role or part list is empty; a null part is skipped; an unknown
part type counts as a document; a null turn sorts first; repeated rows stay, ordered by
(turn, role, content); a null conv_id is one conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART = ("struct<type:string,text:string,ref:string,width:int,height:int,"
        "seconds:double,pages:int>")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _kind(p: Column) -> Column:
    return (F.when(p["type"].isin("text", "image", "audio"), p["type"])
            .when(p["type"].isNull(), F.lit("text")).otherwise("document"))


def _tokens(p: Column, tile: int, tile_tokens: int, base_tokens: int, audio_rate: float,
            page_tokens: int) -> Column:
    """What the placeholder stands for once the model's input is expanded."""
    tiles = (F.ceil(F.coalesce(p["width"], F.lit(0)) / F.lit(tile))
             * F.ceil(F.coalesce(p["height"], F.lit(0)) / F.lit(tile)))
    return (F.when(_kind(p) == "image", tiles * tile_tokens + base_tokens)
            .when(_kind(p) == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate))
            .otherwise(F.coalesce(p["pages"], F.lit(0)) * page_tokens).cast("bigint"))


def format_conversations(turns: DataFrame, tile: int = 512, tile_tokens: int = 170,
                         base_tokens: int = 85, audio_rate: float = 25.0,
                         page_tokens: int = 256) -> DataFrame:
    """``turns``: conv_id, turn, role, parts (array of ``PART``), one row per turn.

    Returns per conversation: conv_id, formatted, loss_spans (code points [start, end) of
    every assistant content, in order), attachments (position, turn, kind, ref, n_tokens in
    reading order) and expanded_tokens (their sum). One shuffle on conv_id; offsets are a
    running sum in that partitioning, so the work is linear in the turns.
    """
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")),
                     lambda p: p.isNotNull())
    content = F.array_join(F.transform(parts, lambda p: F.when(
        _kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))
    ).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))), "")
    attached = F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p: F.struct(
        _kind(p).alias("kind"), p["ref"].alias("ref"),
        _tokens(p, tile, tile_tokens, base_tokens, audio_rate, page_tokens).alias("n_tokens")))
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        content.alias("content"), attached.alias("attached"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    rows = rows.withColumn("chunk", F.concat(head, "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.select(
        "conv_id", "turn", "role", "chunk", "attached", F.row_number().over(order).alias("seq"),
        (F.sum(F.length("chunk").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
         - len(END)).alias("stop"), F.length("content").cast("bigint").alias("n"))
    by_turn = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "seq", "turn", "role", "chunk", "attached", (F.col("stop") - F.col("n")).alias("start"),
        "stop"))).alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: F.struct(
        t["start"].alias("start"), t["stop"].alias("end")))
    found = F.flatten(F.transform("t", lambda t: F.transform(t["attached"], lambda a: F.struct(
        t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"),
        a["n_tokens"].alias("n_tokens")))))
    return by_turn.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["chunk"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.transform(found, lambda a, i: F.struct(
            i.alias("position"), a["turn"].alias("turn"), a["kind"].alias("kind"),
            a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))).alias("attachments"),
        F.aggregate(found, F.lit(0).cast("bigint"), lambda s, a: s + a["n_tokens"]).alias("expanded_tokens"))


def text_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as turns of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"),
                    F.lit(None).alias("ref"), F.lit(None).alias("width"), F.lit(None).alias("height"),
                    F.lit(None).alias("seconds"), F.lit(None).alias("pages"))
    return conversations.select("conv_id", "turn", "role", F.array(part).cast(f"array<{PART}>").alias("parts"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: adds turns (array of role, text; placeholders stay as they
    are) and loss_text (all text under the loss spans, unescaped)."""
    pieces = F.split("formatted", r"<\|im_end\|>")
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
        unescape(F.element_at(F.split(p, r"<\|im_sep\|>", 2), 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def digest(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(told).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens")
