"""Chat formatting of typed content parts, by built-in functions alone.

A turn's parts (text, image, audio, document) are visited in order: text is
escaped, any other part becomes a numbered placeholder and is recorded as an
attachment with the number of tokens it expands to.  The template is

    <s>[INST]role[/INST]body</s>[INST]role[/INST]body</s>...

In roles and texts the signs that control strings start with are escaped
(``\\`` as ``\\b``, ``<`` as ``\\l``, ``[`` as ``\\o``), so ``<`` and ``[`` stand
for control strings and placeholders only, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, ROLE, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"

#: A content part.  ``amount`` and ``amount2``: width and height, seconds, or pages.
PART = "struct<type: string, text: string, ref: string, amount: double, amount2: double>"
IMAGE_PATCH = 28          # one token a patch of so many pixels each way
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\o"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\o"), F.lit("[")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """The parts of a text-only turn."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount"),
                            F.lit(None).cast("double").alias("amount2")))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) != "text"


def _tokens(part: Column) -> Column:
    """Tokens that a part expands to; unknown sizes and types count as one."""
    patches = F.ceil(part["amount"] / IMAGE_PATCH) * F.ceil(part["amount2"] / IMAGE_PATCH)
    size = (F.when(part["type"] == "image", patches)
            .when(part["type"] == "audio", F.ceil(part["amount"] * AUDIO_TOKENS_A_SECOND))
            .when(part["type"] == "document", F.ceil(part["amount"]) * DOCUMENT_TOKENS_A_PAGE))
    return F.greatest(F.coalesce(size, F.lit(1)).cast("long"), F.lit(1).cast("long"))


def _visit(part: Column, number: Column) -> Column:
    """What a part becomes in the body."""
    placeholder = F.concat(F.lit("["), escape(F.coalesce(part["type"], F.lit(""))), F.lit(":"), number.cast("string"), F.lit("]"))
    return F.when(_is_attachment(part), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation from ``conv_id, turn, role, parts`` (array of PART; other columns are ignored).

    ``formatted``; ``segments``: array of (piece, loss) that concatenate to it;
    ``loss_spans``: array of (start, length) in code points, the same mask;
    ``attachments``: array of (number, type, ref, tokens) in order.
    Turns are ordered by turn, role and parts (nulls first), so ties have a
    defined order; a null role or text is empty, a null conv_id is a
    conversation of its own, null or empty parts are an empty body.
    A conversation is one output string, so its turns meet in one task.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    base = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    base = base.withColumn("n_here", F.size(F.filter("parts", _is_attachment)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    numbered = (base.withColumn("nth", F.row_number().over(order))
                .withColumn("before", F.sum("n_here").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_here")))
    number = lambda i: F.col("before") + F.size(F.filter(F.slice("parts", 1, i + 1), _is_attachment))
    seen = F.transform("parts", lambda part, i: F.struct(
        _visit(part, number(i)).alias("piece"),
        F.when(_is_attachment(part), F.struct(number(i).alias("number"), part["type"].alias("type"), part["ref"].alias("ref"),
                                              _tokens(part).alias("tokens"))).alias("attachment")))
    head = F.concat(F.when(F.col("nth") == 1, F.lit(BEGIN)).otherwise(F.lit("")), F.lit(ROLE), escape(F.col("role")), F.lit(BODY))
    rendered = (numbered.withColumn("seen", seen)
                .select("conv_id", "nth", head.alias("head"), F.array_join("seen.piece", "").alias("body"),
                        (F.col("role") == LEARNED_ROLE).alias("loss"),
                        F.filter("seen.attachment", lambda a: a.isNotNull()).alias("attached")))
    along = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("head") + F.length("body") + len(END)
    placed = rendered.withColumn("start", F.sum(length).over(along) - F.length("body") - len(END))
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("nth", "head", "body", "loss", "start", "attached"))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t["head"].alias("piece"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("piece"), t["loss"].alias("loss")),
        F.struct(F.lit(END).alias("piece"), F.lit(False).alias("loss")))))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]),
                        lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).alias("length")))
    return (listed.withColumn("segments", segments)
            .select("conv_id", F.array_join("segments.piece", "").alias("formatted"), "segments", spans.alias("loss_spans"),
                    F.flatten("turns.attached").alias("attachments")))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted string; placeholders stay as they stand."""
    whole = F.substring(formatted, len(BEGIN) + 1, 2 ** 31 - 1)
    turns = F.split(whole, END)
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(
        unescape(F.split(F.substring(t, len(ROLE) + 1, 2 ** 31 - 1), r"\[/INST\]", 2)[0]).alias("role"),
        unescape(F.split(t, r"\[/INST\]", 2)[1]).alias("text")))


def read_loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Figures read back from :func:`format_conversations`' output."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                            read_loss_text(F.col("segments")).alias("loss_text"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def oracle_sql(table: str = "conversations") -> str:
    """The figures in DuckDB SQL, from the texts themselves."""
    escaped = "replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '[', '\\o')"
    fixed = len(ROLE + BODY + END)
    return f"""with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {table}
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as told,
         coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = '{LEARNED_ROLE}'), '') as learned,
         {len(BEGIN)} + sum(length({escaped.format('role')}) + length({escaped.format('text')}) + {fixed}) as chars
  from t group by conv_id
)
select conv_id, n_turns, sha256(told) as turns_sha256, length(learned) as loss_chars,
       sha256(learned) as loss_sha256, chars::bigint as formatted_chars from c"""
