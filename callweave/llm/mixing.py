"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, each source gets a target, and the target over the source's size is the repetition rate.
A document is emitted floor(rate) times, plus once more if a number in [0, 1) made from its id and the seed is under the
rate's fraction. Reruns and repeated rows of one id decide alike. A null text has size 0, a null source is a source of
its own (the last), an empty table gives an empty result. Texts of any length count whole. Extra columns, whatever their names, are carried along
untouched. Sources of equal limits over weights are filled in order of their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import n_words, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the key and the seed."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, size) rows of documents -> (source, source_size, target).

    Weights go round the sources in code-point order, null last. Targets share the total by weight but stop at
    ``max_repeat`` times the source's size; what is over goes to the others by weight. The level at which that ends is
    found in one pass over the sources ordered by limit over weight. The windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("stop", F.lit(float(max_repeat)) * F.col("source_size"))
    full = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    by = by.withColumn("level", level)
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), F.col("level")))).over(every)["level"])
    target = F.least(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"), F.col("stop"))
    return by.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """``docs`` with the struct column ``_cw_mix``: size, source_size, target, copies."""
    sized = docs.withColumn("_cw_size", n_words(F.col("text")))
    targets = source_targets(sized.select("source", F.col("_cw_size").alias("size")), weights, max_repeat)
    targets = targets.select(F.col("source").alias("_cw_source"), "source_size", "target")
    targets = targets.select("_cw_source", F.struct("source_size", "target").alias("_cw_t"))
    # One row per source: Spark broadcasts it if its measured size is under the session's threshold, else joins by key.
    out = sized.join(targets, sized["source"].eqNullSafe(targets["_cw_source"]), "left")
    rate = F.when(F.col("_cw_t.source_size") > 0, F.col("_cw_t.target") / F.col("_cw_t.source_size")).otherwise(F.lit(0.0))
    extra = F.when(unit_hash(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    plan = F.struct(
        F.col("_cw_size").alias("size"), F.col("_cw_t.source_size").alias("source_size"), F.col("_cw_t.target").alias("target"), (F.floor(rate) + extra).cast("int").alias("copies")
    )
    return out.withColumn("_cw_mix", plan).drop("_cw_size", "_cw_source", "_cw_t")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixture itself: each document as many times as its plan says, with the columns of ``docs``."""
    plan = mix_plan(docs, **parameters).filter("_cw_mix.copies > 0")
    return plan.withColumn("_cw_copy", F.explode(F.sequence(F.lit(1), F.col("_cw_mix.copies")))).drop("_cw_mix", "_cw_copy")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    m = F.col("_cw_mix")
    return plan.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))


ORACLE = {
    "op8_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    3.0::DOUBLE * source_size AS stop FROM s),
l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
f AS (SELECT coalesce((SELECT level FROM l WHERE level * weight <= stop ORDER BY stop / weight, level LIMIT 1), 0) AS level),
t AS (SELECT source, source_size, least(f.level * weight, stop) AS target FROM l, f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""",
}
