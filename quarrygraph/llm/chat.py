r"""Relational chat formatting: turns are collected, sorted, merged and joined by Spark expressions only.

Template: ``<|role|>`` NAME ``<|text|>`` TEXT (``<|more|>`` TEXT)* ``<|end|>`` for each run of turns with one role, line feeds
nowhere added.  Inside texts and names ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no text can hold a control string
and undoing is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The template's control strings.
ROLE, TEXT, MORE, END = "<|role|>", "<|text|>", "<|more|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conv_id: formatted string, segments array<struct<text, loss>> whose texts joined are ``formatted``, n_turns.

    Turns are sorted by turn (nulls first), then role and text, so ties and repeated rows have a fixed order; adjacent
    turns of one role are one block.  A null text or role is empty.  ``loss`` marks the texts of trained roles, nothing
    of the template.  A null conv_id is a conversation too; an empty table stays empty; very long texts are taken whole;
    other columns, whatever their names, are not read.  One conversation is one output row, so it is built in one task, in
    time linear in its length.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    n = F.size("t")
    # block starts, and each block as the slice up to the next start
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("t", i.cast("int"))["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)).cast("int"))["role"]))
    cut = sorted_turns.withColumn("s", starts)
    ends = F.concat(F.slice(F.col("s"), 2, F.greatest(F.size("s") - 1, F.lit(0))), F.array(n + 1))
    blocks = F.zip_with("s", ends, lambda a, b: F.struct(F.element_at("t", a.cast("int"))["role"].alias("role"), F.transform(F.slice(F.col("t"), a, b - a), lambda x: x["text"]).alias("texts")))
    merged = cut.select("conv_id", n.alias("n_turns"), blocks.alias("blocks"))

    def segments(block: Column) -> Column:
        loss = block["role"].isin(*trained_roles)
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        texts = F.transform(block["texts"], lambda x, i: F.array(plain(F.when(i == 0, F.concat(F.lit(ROLE), escape(block["role"]), F.lit(TEXT))).otherwise(F.lit(MORE))), F.struct(escape(x).alias("text"), loss.alias("loss"))))
        return F.concat(F.flatten(texts), F.array(plain(F.lit(END))))

    out = merged.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.flatten(F.transform("blocks", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_turns")


def parse(formatted: Column) -> Column:
    """The turns behind a formatted string: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, TEXT, 1)
        role = unescape(F.substring(head, len(ROLE) + 1, 1 << 30))
        body = F.split(F.substring(b, F.char_length(head) + len(TEXT) + 1, F.lit(1 << 30)), r"<\|more\|>", -1)
        return F.transform(body, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, without escapes."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose two turns hold strings that look like a template."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_conversations(turns).select("conv_id", "formatted", "segments")
    back = done.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said_all, "UTF-8"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe, replace(replace(role, '\', '\\'), '<|', '<\|') AS safe_role,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS k FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN before IS NULL OR before <> role THEN length('<|role|>') + length(safe_role) + length('<|text|>') + length('<|end|>') ELSE length('<|more|>') END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
