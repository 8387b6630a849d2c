"""Chat formatting with typed content parts, by column functions only.

A turn's content is a list of parts. Texts are escaped; images, audio and documents become
placeholders in their order, with a reference to the attachment and the tokens it expands to. The
loss mask lists the places of the texts that are learned, so placeholders and marks are outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import let, running_starts

#: A part: its type, its text or its attachment, and what its token count follows from.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

# Strings of the template. No text can hold them once it is escaped.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_OPEN = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_CLOSE = "<|ref|>"
#: Role whose texts are learned.
LEARNED = "assistant"
#: Control strings of this and of other common templates, after their first character.
_CONTROL = r"(?=\||/?s>|/?INST\]|/?SYS>)"

#: Pixels of an image tile's side and tokens of a tile, audio tokens a second, tokens of a page.
TILE, TILE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 28, 1, 25, 256


def escape(text: Column) -> Column:
    """Put a backslash behind the first character of each control string, and one more where some
    already follow it, so that ``unescape`` gives back any text."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2")


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; a text has none here, its tokens depend on a vocabulary."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / TILE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / TILE)
    return (
        F.when(part["type"] == "image", tiles * TILE_TOKENS)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SECOND_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(part: Column) -> Column:
    """What a part adds to its turn: an escaped text or a placeholder with the escaped reference.
    Parts of other types, and null parts, count as texts."""
    text = escape(F.coalesce(part["text"], F.lit("")))
    out = text
    for kind, mark in _OPEN.items():
        out = F.when(part["type"] == kind, F.concat(F.lit(mark), escape(F.coalesce(part["ref"], F.lit(""))), F.lit(_CLOSE))).otherwise(out)
    return out


def text_parts(text: Column) -> Column:
    """A content of one text part; null is empty."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    one = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in null.items()])
    return F.array(one).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learned_role: str = LEARNED) -> DataFrame:
    """One row a conversation: (conv_id, n_turns, formatted, loss, attachments, attachment_tokens).

    ``parts`` is an array of PART. Turns are in the order of their number, null first, and turns of
    one number in that of role and content; a null role is empty, null parts are none. loss has, for
    each turn, the places (start, end) in ``formatted`` of its texts, if ``learned_role`` said them;
    empty texts have none. attachments are (turn, part, type, ref, tokens) in their order, turn and
    part counted from 0. Rows with a null conversation form one. Repeated turns stay; an empty table
    gives an empty result.
    """
    said = F.coalesce(F.col(role), F.lit(""))
    items = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    pieces = F.transform(items, lambda p: F.struct(F.coalesce(p["type"].isin(*_OPEN), F.lit(False)).alias("attached"), visit(p).alias("text")))
    files = F.filter(
        F.transform(items, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))),
        lambda x: F.coalesce(x["type"].isin(*_OPEN), F.lit(False)),
    )
    each = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said.alias("role"), pieces.alias("pieces"), files.alias("files"))
    starts = running_starts(F.transform("pieces", lambda p: F.length(p["text"])))
    texts = F.filter(
        F.zip_with("pieces", starts, lambda p, at: F.struct(at.alias("start"), F.when(p["attached"], at).otherwise(at + F.length(p["text"])).alias("end"))),
        lambda x: (F.col("role") == learned_role) & (x["start"] < x["end"]),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    body = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    one = F.struct("turn", "role", body.alias("body"), "files", head.alias("head"), texts.alias("texts"))
    chats = each.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    sizes = F.transform("ts", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END))
    chats = chats.withColumn("starts", running_starts(sizes))
    text = F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END)))

    def placed(t: Column, at: Column) -> Column:
        return F.transform(t["texts"], lambda x: F.struct((at + F.length(t["head"]) + x["start"]).alias("start"), (at + F.length(t["head"]) + x["end"]).alias("end")))

    numbered = F.transform("ts", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("turn"), f["part"].alias("part"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))
    out = chats.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(text, "").alias("formatted"), F.zip_with("ts", "starts", placed).alias("loss"), F.flatten(numbered).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, f: n + f["tokens"]))


def read_back(formatted: Column) -> Column:
    """Turns (role, parts) of a formatted chat, parts being (type, text, ref). A body is cut at its
    placeholders before anything is unescaped, so a text that looks like one stays a text; texts
    beside each other come back as one."""
    turn = F.lit(r"(?s)\G<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>")
    kinds = "|".join(_OPEN)
    part = F.lit(rf"(?s)\G(?:<\|({kinds})\|>(.*?)<\|ref\|>|(.+?)(?=<\|(?:{kinds})\|>|\z))")

    def parts(body: Column) -> Column:
        kind, ref, text = (F.regexp_extract_all(body, part, F.lit(i)) for i in (1, 2, 3))
        both = F.zip_with(kind, ref, lambda k, r: F.struct(k.alias("type"), unescape(r).alias("ref")))
        return F.zip_with(both, text, lambda a, t: F.when(a["type"] == "", F.struct(F.lit("text").alias("type"), unescape(t).alias("text"), F.lit(None).cast("string").alias("ref"))).otherwise(F.struct(a["type"].alias("type"), F.lit(None).cast("string").alias("text"), a["ref"].alias("ref"))))

    roles, bodies = F.regexp_extract_all(formatted, turn, F.lit(1)), F.regexp_extract_all(formatted, turn, F.lit(2))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(unescape(r).alias("role"), parts(b).alias("parts")))


def text_of(turn: Column) -> Column:
    """The texts of a turn that was read back, nothing between."""
    return F.array_join(F.transform(F.filter(turn["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def learned(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, cut out of ``formatted`` and unescaped, nothing between.

    Each turn is cut out of its own part of the chat, so long chats take linear time."""
    turns = F.regexp_extract_all(formatted, F.lit(r"(?s)\G<\|turn\|>.*?<\|end\|>"), F.lit(0))

    def cut(turn: Column, x: Column) -> Column:
        return F.array_join(F.transform(x["loss"], lambda s: unescape(F.substring(turn, s["start"] - x["at"] + 1, s["end"] - s["start"]))), "")

    def joined(ts: Column) -> Column:
        places = F.zip_with(running_starts(F.transform(ts, F.length)), loss, lambda at, s: F.struct(at.alias("at"), s.alias("loss")))
        return F.array_join(F.zip_with(ts, places, cut), "")

    return let(turns, joined)
