"""Column profiles kept per segment and merged.

Appending a segment to an entity reads that segment only: one aggregate over it
writes, per column, counts, moments, the extremes, a quantile sketch (KLL) and a
distinct sketch (HLL).  The profile of the whole entity is a merge of the stored rows, one
row per column and segment, and never reads the data again.  Counts, extremes, sums and
means are exact.  A quantile has a rank within ``RANK_ERROR`` of the one asked for, and the
distinct count is within ``DISTINCT_ERROR`` of the exact one (both at 99 %).  The exact profile
(:mod:`tessera.operators.profile`) is unchanged beside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import path_exists

# Sizes of the sketches; the errors are those that their authors publish for these sizes.
KLL_K = 1000
HLL_LG_K = 13
RANK_ERROR = 0.01
DISTINCT_ERROR = 0.05
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _stats(c: str, x: Column, is_time: bool) -> Column:
    """The stored row of one column; ``x`` is its value as a double (microseconds of a time)."""
    finite = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return F.struct(
        F.lit(c).alias("variable"), F.lit(is_time).alias("is_time"), F.count(F.lit(1)).alias("rows"), F.count(F.col(c)).alias("n"),
        F.count(finite).alias("finite"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.sum(finite).alias("sum"),
        F.avg(finite).alias("mean"), (F.var_pop(finite) * F.count(finite)).alias("m2"),
        F.count_if(finite == 0).alias("zeros"), F.count_if(finite < 0).alias("negatives"),
        F.kll_sketch_agg_double(finite, F.lit(KLL_K)).alias("quantiles"),
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_LG_K)).alias("distinct"))


def segment_sketch(df: DataFrame, numeric: Sequence[str] = (), datetime: Sequence[str] = ()) -> DataFrame:
    """One row per column, from one aggregate over ``df``."""
    parts = [_stats(c, F.col(c).cast("double"), False) for c in numeric]
    parts += [_stats(c, F.unix_micros(F.col(c).cast("timestamp")).cast("double"), True) for c in datetime]
    return df.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))


def append_segment(df: DataFrame, root: str, segment: str, numeric: Sequence[str] = (), datetime: Sequence[str] = ()) -> None:
    """Store the sketches of one segment below ``root``; the same segment again replaces its own row only."""
    if "/" in segment or "=" in segment or not segment:
        raise ValueError(f"not a segment name: {segment!r}")
    segment_sketch(df, numeric, datetime).coalesce(1).write.mode("overwrite").parquet(f"{root}/segment={segment}")


def merged_profile(spark: SparkSession, root: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """The profile over all segments below ``root``: ``variable, is_time, segments, rows, n, missing, min, max, range,
    mean, std, sum, zeros, negatives, infinite, n_distinct, quantiles`` (an array in the order asked for).

    Minimum and maximum of a time are microseconds, see :func:`as_time`."""
    if not path_exists(spark, root):
        raise FileNotFoundError(root)
    s = spark.read.parquet(root)
    merged = s.groupBy("variable", "is_time").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("finite").alias("finite"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"),
        # the squares about each segment's mean, and of the segments' means about the whole
        F.sum("m2").alias("_within"),
        F.collect_list(F.struct("finite", "mean")).alias("_means"),        # one row a segment
        F.sum("zeros").alias("zeros"), F.sum("negatives").alias("negatives"),
        F.kll_merge_agg_double("quantiles", F.lit(KLL_K)).alias("_q"), F.hll_union_agg("distinct").alias("_d"))
    mean = F.col("sum") / F.nullif(F.col("finite"), F.lit(0))
    between = F.aggregate("_means", F.lit(0.0), lambda a, m: a + F.coalesce(
        m["finite"] * F.pow(m["mean"] - F.col("mean"), 2), F.lit(0.0)))
    with_mean = merged.withColumn("mean", mean)
    std = F.when(F.col("finite") > 1, F.sqrt((F.coalesce("_within", F.lit(0.0)) + between) / (F.col("finite") - 1)))
    asked = F.array(*[F.lit(float(p)) for p in quantiles])
    return with_mean.select(
        "variable", "is_time", "segments", "rows", "n", (F.col("rows") - F.col("n")).alias("missing"), "min", "max",
        (F.col("max") - F.col("min")).alias("range"), "mean", std.alias("std"), "sum", "zeros", "negatives",
        (F.col("n") - F.col("finite")).alias("infinite"), F.hll_sketch_estimate("_d").alias("n_distinct"),
        F.when(F.col("finite") > 0, F.kll_sketch_get_quantile_double("_q", asked)).alias("quantiles"))


def as_time(micros: Column) -> Column:
    return F.timestamp_micros(micros.cast("long"))


def segments(spark: SparkSession, root: str) -> list[str]:
    """Names of the segments stored below ``root``."""
    return sorted(r["segment"] for r in spark.read.parquet(root).select(F.col("segment").cast("string")).distinct().collect())
