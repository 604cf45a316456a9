"""Mixing sources to target weights, with DataFrame functions only.

Sources in code point order (null last) take the weights in turn and share ``share`` times all words. No target
exceeds ``max_rate`` times its source's words; the excess goes to the other sources by weight until none is above
(the water level is found from one ordered pass over the sources, which are one row each). A document is taken
floor(rate) times and once more with probability rate - floor(rate), drawn from a hash of seed and id, so reruns
agree whatever the partitioning.

Defined results: a null text has size 0; a source without words has target 0 and takes nothing; the null source is
a source; rows that repeat an id share its draw; an empty table gives an empty result; input columns may have any
other names, the operator's own are prefixed with ``kf_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, few

WEIGHTS, SHARE, MAX_RATE, SEED = (5, 2, 1), 1.5, 2.0, "keyfold-mix-1"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(kf_source, kf_source_size, kf_target) from a table with kf_source and kf_size, pre-aggregated per source."""
    per = sizes.groupBy("kf_source").agg(F.sum("kf_size").alias("kf_source_size"))
    by_name = Window.orderBy(F.col("kf_source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("kf_source_size") * F.lit(max_rate))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("kf_source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("kf_source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("weight_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("place", F.row_number().over(by_ratio))
    uncapped = F.col("left") * F.col("w") <= F.col("cap") * F.col("weight_left")
    level = F.min_by(F.when(uncapped, F.col("left") / F.col("weight_left")), F.when(uncapped, F.col("place"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return per.select("kf_source", "kf_source_size", target.alias("kf_target"))


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) plus one Bernoulli draw: 52 bits of an MD5 digest against the fraction."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _goals(sizes: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """(kf_name, kf_source_size, kf_target, kf_rate), one row for each source, stored so that its size is known."""
    rate = F.when(F.col("kf_source_size") > 0, F.col("kf_target") / F.col("kf_source_size")).otherwise(F.lit(0.0))
    return scratch.write(targets(sizes, **how).withColumnRenamed("kf_source", "kf_name").withColumn("kf_rate", rate), "goals")


def planned(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """doc_id, source, kf_size, kf_source_size, kf_target and kf_copies of every row; texts are read once."""
    scratch = Scratch(df.sparkSession, "mixing")
    sized = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("kf_size"))
    sized = scratch.write(sized, "sizes")
    goals = _goals(sized.select(F.col("source").alias("kf_source"), "kf_size"), scratch, **how)
    joined = sized.join(few(goals), F.col("source").eqNullSafe(F.col("kf_name")), "left")
    return joined.select("doc_id", "source", "kf_size", "kf_source_size", "kf_target", copies(F.col("doc_id"), F.col("kf_rate")).alias("kf_copies"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixture itself: every row of ``df`` as often as it is taken, with the columns of ``df``, whatever their names."""
    scratch, names = Scratch(df.sparkSession, "mixing"), [f"c{i}" for i in range(len(df.columns))]
    goals = _goals(df.select(F.col(source).alias("kf_source"), size_of(text).alias("kf_size")), scratch, **how)
    at = dict(zip(df.columns, names, strict=True))
    rows = df.toDF(*names).join(few(goals), F.col(at[source]).eqNullSafe(F.col("kf_name")), "left")
    taken = copies(F.col(at[doc_id]), F.col("kf_rate"))
    rows = rows.select(*names, F.explode(F.when(taken > 0, F.sequence(F.lit(1).cast("long"), taken))).alias("kf_copy"))
    return rows.select(*names).toDF(*df.columns)
