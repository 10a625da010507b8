"""Preference formatting of conversations, with DataFrame functions only.

A preference pair is two arrays of turns (role, text). Their longest common prefix of equal turns is rendered once as the
prompt; what follows it on either side is rendered as that side's completion, with a mask that trains on the content and
the end mark of assistant turns only. Null arrays count as empty; null roles and texts as empty strings, and two nulls
are equal. Equal sides give empty completions. Rows whose conversation id is null belong to no conversation and give none.
Repeated rows are repeated turns. Texts of any length are rendered whole. Other columns, whatever their names, aren't looked
at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, turns), ordered by turn, then role and text on ties, null first."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    turns = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(turns.alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns at the start are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, False)
    return F.when(first_other > 0, first_other - 1).otherwise(n).cast("int")


def _after(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def segments(turns: Column) -> Column:
    """Each turn as two pieces of text: its head, never trained, and its content with the end mark, trained if an assistant's."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("train")),
                F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), (t["role"] == "assistant").alias("train")),
            ),
        )
    )


def joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda s: s["text"]), "")


def mask(pieces: Column) -> Column:
    """Runs of characters with their loss flag, in order: ``n:0`` or ``n:1``, comma separated."""
    return F.array_join(F.transform(pieces, lambda s: F.concat(F.length(s["text"]).cast("string"), F.lit(":"), s["train"].cast("int").cast("string"))), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` has the arrays ``chosen`` and ``rejected``; adds the struct ``formatted`` (n_common, prompt, and text and mask of both)."""
    chosen, rejected = (F.coalesce(F.col(c), F.array().cast(TURNS)) for c in ("chosen", "rejected"))
    n = common_prefix(chosen, rejected)
    a, b = segments(_after(chosen, n)), segments(_after(rejected, n))
    out = F.struct(
        n.alias("n_common"),
        joined(segments(F.slice(chosen, F.lit(1), n))).alias("prompt"),
        joined(a).alias("chosen"), mask(a).alias("chosen_mask"), joined(b).alias("rejected"), mask(b).alias("rejected_mask"),
    )
    return pairs.withColumn("formatted", out)


def swapped_answers(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, chosen, rejected): each conversation against its turns before its last
    assistant turn followed by the last assistant turn of its neighbour (ids 2k and 2k+1 are neighbours).

    Without an assistant turn of its own all its turns are the prompt; without one of the neighbour's nothing follows.
    Neighbours are brought together by one grouping.
    """
    both = F.sort_array(F.collect_list(F.struct("conv_id", "turn", "role", "text")))
    pairs = rows.filter(F.col("conv_id").isNotNull()).groupBy(F.shiftright("conv_id", 1).alias("pair")).agg(both.alias("both"))

    def side(bit: int) -> Column:
        own = F.filter("both", lambda t: t["conv_id"].bitwiseAND(F.lit(1)) == bit)
        return F.transform(own, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    def entry(bit: int) -> Column:
        return F.struct((F.shiftleft("pair", 1) + bit).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col(f"turns{bit}").alias("turns"), F.col(f"turns{1 - bit}").alias("other"))

    sides = pairs.select("pair", side(0).alias("turns0"), side(1).alias("turns1"))
    c = sides.select(F.inline(F.array(entry(0), entry(1)))).filter(F.size("turns") > 0)
    # Where the last assistant turn is, from 1; null without one.
    last = lambda turns: F.size(turns) - F.nullif(F.array_position(F.reverse(F.transform(turns, lambda t: t["role"] == "assistant")), True), F.lit(0)).cast("int") + 1
    c = c.withColumns({"last": last(F.col("turns")), "theirs": last(F.col("other"))})
    answer = F.when(F.col("theirs").isNotNull(), F.array(F.get("other", F.col("theirs") - 1))).otherwise(F.array().cast(TURNS))
    start = F.when(F.col("last").isNotNull(), F.slice("turns", F.lit(1), F.col("last") - 1)).otherwise(F.col("turns"))
    return c.select("conv_id", F.col("turns").alias("chosen"), F.concat(start, answer).alias("rejected"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = swapped_answers(table(spark, sf_dir, "conversations"))
    return format_preferences(pairs).select("conv_id", "formatted.*")


_SEG = r"flatten(list_transform({t}, lambda t: [{{'text': '<|im_start|>' || t.role || chr(10), 'train': 0}}, {{'text': t.text || '<|im_end|>' || chr(10), 'train': CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END}}]))"
_TEXT = "coalesce(array_to_string(list_transform({s}, lambda s: s.text), ''), '')"
_MASK = "coalesce(array_to_string(list_transform({s}, lambda s: CAST(length(s.text) AS VARCHAR) || ':' || CAST(s.train AS VARCHAR)), ','), '')"

ORACLE = {
    "op1_preference_format": f"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, len(turns) - list_position(list_reverse(list_transform(turns, lambda t: t.role = 'assistant')), true) + 1 AS last FROM c),
p AS (
  SELECT a.conv_id, a.turns AS chosen,
    list_concat(CASE WHEN a.last IS NULL THEN a.turns ELSE a.turns[1:a.last - 1] END, CASE WHEN b.last IS NULL THEN [] ELSE [b.turns[b.last]] END) AS rejected
  FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
n AS (
  SELECT *, len(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda k: chosen[1:k] = rejected[1:k])) AS n_common FROM p),
s AS (
  SELECT conv_id, n_common, {_SEG.format(t="chosen[1:n_common]")} AS ps, {_SEG.format(t="chosen[n_common + 1:]")} AS cs, {_SEG.format(t="rejected[n_common + 1:]")} AS rs FROM n)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common, {_TEXT.format(s="ps")} AS prompt, {_TEXT.format(s="cs")} AS chosen, {_MASK.format(s="cs")} AS chosen_mask,
  {_TEXT.format(s="rs")} AS rejected, {_MASK.format(s="rs")} AS rejected_mask FROM s
""",
}
