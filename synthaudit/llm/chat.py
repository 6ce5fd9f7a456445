"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is a list of parts (``type``, ``text``, ``ref``,
``tokens``).  A visitor flattens the parts of a turn in order: a text part
becomes its escaped text; an image, audio or document part becomes the
placeholder ``<|image|>``, ``<|audio|>`` or ``<|document|>``, and its
reference and expanded token count are recorded as an attachment of that turn.

Template of a turn: ``<|turn|>ROLE\\nCONTENT<|end|>\\n``.  Inside roles and
texts ``&``, ``<`` and ``[`` (which begin every control string of common
templates) are written ``&amp;``, ``&lt;`` and ``&#91;``, so no text can
imitate a control string and the text can be read back exactly.

Turns are put together in two steps, first the turns of a block of 256 turn
numbers, then the blocks of a conversation; only the finished string of one
conversation has to fit one row, which the output asks for.

Defined cases: a null text is empty; a null role is empty; a null turn comes
first; rows of equal turn number follow by role, then text; a null
``conv_id`` is a conversation; an unknown part type is a ``document``;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
KINDS = ("image", "audio", "document")
BLOCK_TURNS = 256
PARTS = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """The parts of a message that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))).cast(PARTS)


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("text", *KINDS), part["type"]).otherwise(F.lit("document"))


def _visit(part: Column) -> Column:
    return F.when(_kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))
                  ).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation of ``messages`` (``conv_id, turn, role,
    parts``): ``formatted``; ``loss_spans`` (which turn, where inside it, how
    many code points are trained on: the content of assistant turns);
    ``attachments`` in order of appearance; ``expanded_tokens``."""
    role = F.coalesce("role", F.lit(""))
    parts = F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p.isNotNull())
    turns = messages.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    content = F.array_join(F.transform("parts", _visit), "")
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    attached = F.transform(F.filter("parts", lambda p: _kind(p) != "text"), lambda p: F.struct(
        _kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).cast("long").alias("tokens")))
    turns = turns.select("conv_id", "turn", "role", content.alias("content"), head.alias("head"),
                         attached.alias("attached"))
    one = F.struct("turn", "role", "content", F.concat("head", "content", F.lit(END)).alias("string"),
                   F.length("head").alias("start"), F.length("content").alias("size"), "attached")
    blocks = (turns.groupBy("conv_id", F.floor(F.col("turn") / BLOCK_TURNS).alias("block"))
              .agg(F.sort_array(F.collect_list(one)).alias("t"))
              .select("conv_id", "block", F.array_join(F.transform("t", lambda x: x["string"]), "").alias("string"),
                      F.transform("t", lambda x: F.struct(
                          (x["role"] == "assistant").alias("trained"), x["start"].alias("start"),
                          x["size"].alias("size"), x["attached"].alias("attached"))).alias("t")))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "string", "t"))).alias("b"))
    whole = whole.select("conv_id", F.array_join(F.transform("b", lambda x: x["string"]), "").alias("formatted"),
                         F.flatten(F.transform("b", lambda x: x["t"])).alias("t"))
    numbered = F.transform("t", lambda x, i: F.struct(
        i.alias("turn"), x["trained"].alias("trained"), x["start"].alias("start"), x["size"].alias("size"),
        x["attached"].alias("attached")))
    spans = F.transform(F.filter("t", lambda x: x["trained"]), lambda x: F.struct(
        x["turn"].alias("turn"), x["start"].alias("start"), x["size"].alias("length")))
    attachments = F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(
        x["turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = whole.withColumn("t", numbered).select("conv_id", "formatted", spans.alias("loss_spans"),
                                                 attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (``role``, ``text``) and the text under the loss mask, read
    from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2_147_483_647)
    cut = formatted.withColumn("pieces", pieces)
    turns = F.transform("pieces", lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(2),
                          F.length(p) - F.length(F.substring_index(p, "\n", 1)) - F.lit(1 + len(END)))).alias("text")))
    under = F.transform("loss_spans", lambda s: unescape(F.substr(
        F.get("pieces", s["turn"]), s["start"] + F.lit(1 - len(TURN)), s["length"])))
    return cut.select("*", turns.alias("turns"), F.array_join(under, "").alias("loss_text")).drop("pieces")
