"""Chat formatting with typed content parts.

A visitor walks the parts of each turn in order: texts are escaped and kept, images, audio and
documents become numbered placeholders, and each of those leaves a record of its reference and of
the tokens it will expand to. Turns are marked by control strings; whatever looks like the start of
a control string inside a text or a role is escaped so that the text comes back exactly.

    <s> <|turn|>role\\nbody<|end|> ... </s>        (without the blanks)

All of it is column expressions; one aggregation brings the turns of a conversation together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, TURN, TURN_END = "<s>", "</s>", "<|turn|>", "<|end|>"

#: A content part. Text parts use text; the others ref and what their token count depends on.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """No control string starts in the result, not even with what follows it.

    ``\\\\`` for the escape sign; ``\\l`` and ``\\b`` for a ``<`` or ``[`` that could begin a control
    string (those of other templates, such as [INST] and <<SYS>>, included); ``\\n`` never occurs
    here, it is used for roles.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, r"<(?=[s/|<]|\z)", r"\\l")
    return F.regexp_replace(out, r"\[(?=[I/]|\z)", r"\\b")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: pairs of escape signs are set apart first."""
    one = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), one), "\\")


def text_parts(text: Column) -> Column:
    """Plain text as a list of one part; a null text is an empty one."""
    part = F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.coalesce(text, F.lit("")), F.lit("ref"), F.lit(None).cast("string"), F.lit("width"), F.lit(None).cast("int"), F.lit("height"), F.lit(None).cast("int"), F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("int"))
    return F.array(part)


def expanded_tokens(part: Column, patch: int, audio_rate: int, page_tokens: int) -> Column:
    """Tokens that a part's placeholder stands for; unknown extents count as one unit."""
    side = lambda c: F.ceil(F.coalesce(part[c], F.lit(1)) / F.lit(patch))
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * F.lit(audio_rate)))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * F.lit(page_tokens))
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str | None = None, text_col: str = "text", patch: int = 14, audio_rate: int = 25, page_tokens: int = 256) -> DataFrame:
    """One row a conversation: conv, formatted, loss_spans, attachments, n_turns.

    ``parts_col`` holds arrays of :data:`PART`; without it each row's ``text_col`` is one text part.
    formatted is the whole string; loss_spans are (start, end) in its code points, one for each
    assistant turn's body; attachments list (n, turn, type, ref, tokens) in the order of their
    placeholders ``<|type:n|>``. Turns are ordered by ``turn_col`` and, where that repeats, by role
    and content; null turns come first. Null roles, texts, part lists and types are empty ones (a
    part of unknown type keeps its text). Repeated rows are turns of their own, null conversation
    ids form one conversation, and an empty table gives no rows. Other columns are not read. A
    conversation is one value, so its turns have to meet in one task.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")) if parts_col else text_parts(F.col(text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts")).alias("t"))
    held = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    special = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    # number the attachments of the conversation in order
    found = F.flatten(F.transform("turns", lambda t, k: F.transform(F.filter(t["parts"], special), lambda p: F.struct(k.alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p, patch, audio_rate, page_tokens).alias("tokens")))))
    attachments = F.transform(found, lambda a, k: F.struct((k + 1).alias("n"), a["turn"], a["type"], a["ref"], a["tokens"]))
    count = lambda ps: F.size(F.filter(ps, special))
    held = held.withColumn("attachments", attachments)
    # attachments before each turn, then the flattened body of each
    held = held.withColumn("before", F.transform("turns", lambda t, k: F.aggregate(F.slice(F.col("turns"), F.lit(1), k), F.lit(0), lambda n, u: n + count(u["parts"]))) if parts_col else F.transform("turns", lambda t: F.lit(0)))

    def visit(ps: Column, before: Column) -> Column:
        start = F.struct(F.lit("").alias("body"), before.alias("n"))

        def step(acc: Column, p: Column) -> Column:
            n = acc["n"] + F.when(special(p), 1).otherwise(0)
            mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), n.cast("string"), F.lit("|>"))
            return F.struct(F.concat(acc["body"], F.when(special(p), mark).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("body"), n.alias("n"))

        return F.aggregate(ps, start, step, lambda acc: acc["body"])

    body = (lambda t, k: visit(t["parts"], F.get(F.col("before"), k))) if parts_col else (lambda t, k: escape(t["parts"][0]["text"]))
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))
    held = held.select("conv", "attachments", F.transform("turns", lambda t, k: F.struct(F.concat(F.lit(TURN), role(t), F.lit("\n")).alias("head"), body(t, k).alias("body"), (t["role"] == "assistant").alias("loss"))).alias("made"))
    spans = F.aggregate(
        "made",
        F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(m["body"]) + F.lit(len(TURN_END))).alias("at"),
            F.when(m["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(m["head"])).alias("start"), (acc["at"] + F.length(m["head"]) + F.length(m["body"])).alias("end")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("made", lambda m: F.concat(m["head"], m["body"], F.lit(TURN_END))), ""), F.lit(END))
    return held.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), spans.alias("loss_spans"), "attachments", F.size("made").cast("long").alias("n_turns"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    inner = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted) - F.lit(len(BEGIN) + len(END)))
    raw = F.filter(F.split(inner, r"<\|turn\|>", -1), lambda p, k: k > 0)

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + F.lit(2), F.length(p) - F.length(role) - F.lit(1 + len(TURN_END)))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(raw, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between its spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
