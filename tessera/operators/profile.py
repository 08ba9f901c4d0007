"""Column profiles: table overview, numeric, categorical, date/time, boolean
and histogram statistics, computed on executors.

Plan shape: the per-column scalar statistics of all columns come from one
aggregate.  Distinct and unique counts come from one stacked pass: each row
is exploded into ``(column, value)`` pairs and counted with map-side partial
aggregation, so a value that holds a third of the rows is collapsed before
the shuffle and no per-column ``COUNT(DISTINCT)`` expansion is needed.

Exact quantiles and the median absolute deviation are computed from that
value-count table by a histogram-guided rank search: one aggregate narrows each to a
bin, and only the rows of these bins are looked through (by the driver if they are
few, else by a distributed search): no column's values meet in one task.  ``exact=False`` uses bounded sketches instead
(``approx_percentile``, ``approx_count_distinct``), one pass cheaper.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import Entity
from tessera.session import write_read

# Quantiles reported for numeric columns, histogram bins, and the
# rows per bucket of the monotonicity check.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
HISTOGRAM_BINS = 10
MONOTONIC_BUCKET = 1_000_000


def corrected_skewness(g1: Column, n: Column) -> Column:
    """Sample skewness from Spark's population value: G1 = g1*sqrt(n(n-1))/(n-2)."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis: G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6)."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def _quantiles(c: Column, exact: bool) -> Column:
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    if exact:
        return F.percentile(c, qs)
    return F.percentile_approx(c, qs, 10000)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, value, n)`` for every non-NULL value of every column, in
    one stacked partial aggregate (values as text)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))


def distinct_counts(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """``(variable, n_distinct, n_unique)``; ``n_unique`` counts values seen
    once (NULL when ``exact`` is False)."""
    if not exact:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"),
                                                       F.col(c).alias("n_distinct"),
                                                       F.lit(None).cast("long").alias("n_unique"))
                                             for c in cols])))
    return (value_counts(df, cols).groupBy("variable")
            .agg(F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("n") == 1).alias("n_unique")))


def numeric_value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, x, exact, n)``: each numeric column's distinct non-NaN values
    with their counts, one stacked partial aggregate.  ``x`` is a double;
    ``exact`` is the text of values of a type that a double cannot hold whole,
    so that large integers stay distinct."""
    def exact(c):
        kind = df.schema[c].dataType.typeName()
        return F.col(c).cast("string") if kind in ("decimal", "long") else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x"), exact(c).alias("exact"))
                      for c in cols])
    return (df.select(F.inline(pairs)).where(F.col("x").isNotNull() & ~F.isnan("x"))
            .groupBy("variable", "x", "exact").agg(F.count(F.lit(1)).alias("n")))


def _rank_search(vc: DataFrame, targets: DataFrame) -> DataFrame:
    """``(variable, k, x)``: the value at each target position ``(variable, k)`` of a ``(variable, x, n)``
    table, without putting a variable's values in one task.

    The table is range-sorted on (variable, x) and stored with
    ``monotonically_increasing_id``.  Each row's first position is its
    partition's offset (prefix sums over one row per partition and variable)
    plus a running count inside its sort partition (a window bounded by the
    partition).  The few positions asked for are looked up through a broadcast.
    """
    tagged = (write_read(vc.orderBy("variable", "x").withColumn("_mid", F.monotonically_increasing_id()), "ranks")
              .withColumn("_part", F.shiftright(F.col("_mid"), 33)))
    inside = Window.partitionBy("_part", "variable").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    blocks = tagged.groupBy("_part", "variable").agg(F.sum("n").alias("_bn"))
    before = Window.partitionBy("variable").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    rows = (local.join(F.broadcast(blocks.select("_part", "variable", "_off")), ["_part", "variable"])
            .select("variable", "x", (F.col("_off") + F.col("_local")).alias("_start"), "n"))
    t = F.broadcast(targets)   # a few rows for each column
    return rows.join(t, (rows["variable"] == t["variable"]) & (t["k"] >= rows["_start"])
                     & (t["k"] < rows["_start"] + rows["n"])).select(rows["variable"], "k", "x")


# Bins that one aggregate narrows a quantile to, and the rows of such bins that the driver looks through.
QUANTILE_BINS = 512
DRIVER_ROWS = 50_000


def weighted_quantiles(vc: DataFrame, probs: Sequence[float], name: str = "q") -> DataFrame:
    """Exact quantiles (linear interpolation between closest ranks) from a
    ``(variable, x, n)`` table of finite values and counts (a value may stand in several rows), without a global sort.

    One aggregate gives each variable's limits, a second the counts of ``QUANTILE_BINS``
    bins of equal width between them; so every position that a quantile needs is
    narrowed to one bin.  The rows of these bins come to the driver if they are at most
    ``DRIVER_ROWS`` (counted by the second aggregate); else, where values crowd in a bin, they
    are searched where they are (:func:`_rank_search`).
    Returns ``(variable, <name> array<double>)`` in the order of ``probs``.
    """
    spark = vc.sparkSession
    rows = vc.groupBy("variable").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total")).collect()
    limits = {r["variable"]: r for r in rows}        # one row a column
    schema = f"variable string, {name} array<double>"
    if not limits:
        return spark.createDataFrame([], schema)
    known = F.broadcast(spark.createDataFrame([(v, r["lo"], r["hi"]) for v, r in limits.items()], "variable string, _lo double, _hi double"))
    # halves, so that the widest range stays finite; every step keeps the order of x
    place = (F.col("x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * QUANTILE_BINS
    bin_of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(place), F.lit(QUANTILE_BINS - 1))).otherwise(0).cast("int")
    binned = vc.join(known, "variable").select("variable", "x", "n", bin_of.alias("bin"))
    bins: dict[str, list] = {}
    for r in binned.groupBy("variable", "bin").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("x").alias("lo"),
                                                   F.max("x").alias("hi")).orderBy("variable", "bin").collect():
        bins.setdefault(r["variable"], []).append(r)
    wanted = {v: [(float(p) * (r["total"] - 1)) for p in probs] for v, r in limits.items()}
    value: dict[tuple, float] = {}                   # (variable, position) -> x
    open_bins: dict[tuple, tuple] = {}               # (variable, bin) -> offset, rows, positions
    for v, positions in wanted.items():
        for k in sorted({f(pos) for pos in positions for f in (math.floor, math.ceil)}):
            before = 0
            for b in bins[v]:
                if k < before + b["n"]:
                    break
                before += b["n"]
            if b["lo"] == b["hi"]:
                value[v, k] = b["lo"]
            else:
                open_bins.setdefault((v, b["bin"]), (before, b["rows"], []))[2].append(k)
    if open_bins:
        chosen = F.broadcast(spark.createDataFrame(list(open_bins), "variable string, bin int"))
        left = binned.join(chosen, ["variable", "bin"])
        if sum(n for _, n, _ in open_bins.values()) <= DRIVER_ROWS:
            held: dict[tuple, list] = {}
            for r in left.collect():
                held.setdefault((r["variable"], r["bin"]), []).append((r["x"], r["n"]))
            for (v, b), (before, _, positions) in open_bins.items():
                at, todo = before, sorted(positions)
                for x, n in sorted(held[v, b]):
                    while todo and todo[0] < at + n:
                        value[v, todo.pop(0)] = x
                    at += n
        else:
            keyed = left.select(F.concat_ws("\u0001", "variable", "bin").alias("variable"), "x", "n")
            targets = spark.createDataFrame([(f"{v}\u0001{b}", k - before) for (v, b), (before, _, ks) in open_bins.items() for k in ks],
                                            "variable string, k long")
            for r in _rank_search(keyed, targets).collect():     # one row a position
                v, b = r["variable"].rsplit("\u0001", 1)
                value[v, r["k"] + open_bins[v, int(b)][0]] = r["x"]
    out = []
    for v, positions in wanted.items():
        ends = [(value[v, math.floor(p)], value[v, math.ceil(p)], p - math.floor(p)) for p in positions]
        out.append((v, [lo + part * (hi - lo) for lo, hi, part in ends]))
    return spark.createDataFrame(out, schema)


def numeric_profile(df: DataFrame, cols: Sequence[str], exact: bool = True, sketch_mad: bool = False) -> DataFrame:
    """One row per numeric column: count, missing, min, max, mean, std,
    variance, sum, cv, skewness, kurtosis, zeros, negatives, infinite,
    q05..q95, iqr, range, mad, n_distinct, n_unique.

    Moments and counts come from one aggregate over the rows.  With
    ``exact``, quantiles, the median absolute deviation and the distinct /
    unique counts come from the value-count table (see
    :func:`weighted_quantiles`).  Without ``exact``, bounded sketches over
    the rows are used instead, in the same aggregate; the median absolute
    deviation needs a second pass over the rows and is NULL then unless
    ``sketch_mad`` asks for it.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        aggs += [F.count(x).alias(f"{c}__count"), F.count_if(x.isNull()).alias(f"{c}__missing"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.avg(finite).alias(f"{c}__mean"),
                 F.stddev_samp(finite).alias(f"{c}__std"), F.var_samp(finite).alias(f"{c}__variance"),
                 F.sum(x).alias(f"{c}__sum"), F.skewness(finite).alias(f"{c}__g1"),
                 F.kurtosis(finite).alias(f"{c}__g2"), F.count(finite).alias(f"{c}__nf"),
                 F.count_if(x == 0).alias(f"{c}__zeros"), F.count_if(x < 0).alias(f"{c}__negatives"),
                 F.count_if(F.abs(x) == float("inf")).alias(f"{c}__infinite")]
        if not exact:
            aggs.append(_quantiles(finite, False).alias(f"{c}__q"))
            aggs.append(F.approx_count_distinct(x).alias(f"{c}__nd"))
    stats = df.agg(*aggs)
    rows = []
    for c in cols:
        def s(k, c=c):
            return F.col(f"{c}__{k}")
        nf = s("nf").cast("double")
        extra = ([s("q").alias("q"), s("nd").alias("n_distinct"), F.lit(None).cast("long").alias("n_unique")]
                 if not exact else [])
        rows.append(F.struct(
            F.lit(c).alias("variable"), s("count").alias("count"), s("missing").alias("missing"),
            s("min").alias("min"), s("max").alias("max"), s("mean").alias("mean"), s("std").alias("std"),
            s("variance").alias("variance"), s("sum").alias("sum"),
            F.when(s("mean") != 0, s("std") / s("mean")).alias("cv"),
            corrected_skewness(s("g1"), nf).alias("skewness"), corrected_kurtosis(s("g2"), nf).alias("kurtosis"),
            s("zeros").alias("zeros"), s("negatives").alias("negatives"), s("infinite").alias("infinite"), *extra))
    out = stats.select(F.inline(F.array(*rows)))
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    if exact:
        # distinct values with counts: distinct / unique counts, then exact
        # quantiles and the median absolute deviation, all distributed
        vc = write_read(numeric_value_counts(df, cols), "value-counts")    # read by all three below
        dist = vc.groupBy("variable").agg(F.count(F.lit(1)).alias("n_distinct"),
                                          F.count_if(F.col("n") == 1).alias("n_unique"))
        finite = vc.where(F.abs("x") != float("inf"))
        per = weighted_quantiles(finite, QUANTILES, "q")
        med = per.select("variable", F.col("q")[2].alias("med"))
        devs = (finite.join(F.broadcast(med), "variable")     # one row per column
                .select("variable", F.abs(F.col("x") - F.col("med")).alias("x"), "n"))
        mad = weighted_quantiles(devs, (0.5,), "m").select("variable", F.col("m")[0].alias("mad"))
        out = out.join(per, "variable", "left").join(dist, "variable", "left").join(mad, "variable", "left")
    elif not sketch_mad:
        out = out.withColumn("mad", F.lit(None).cast("double"))
    else:
        med = out.select("variable", F.col("q")[2].alias("med"))
        dev_pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])
        mad = (df.select(F.inline(dev_pairs)).where(F.col("x").isNotNull() & ~F.isnan("x"))
               .join(F.broadcast(med), "variable").groupBy("variable")
               .agg(F.percentile_approx(F.abs(F.col("x") - F.col("med")), F.lit(0.5), 10000).alias("mad")))
        out = out.join(mad, "variable", "left")
    return out.select("*", *[F.col("q")[i].alias(f"q{int(round(q * 100)):02d}") for i, q in enumerate(QUANTILES)],
                      (F.col("q")[3] - F.col("q")[1]).alias("iqr"), (F.col("max") - F.col("min")).alias("range")
                      ).drop("q")


def monotonic(df: DataFrame, cols: Sequence[str], line_col: str = "line_number",
              bucket: int = MONOTONIC_BUCKET) -> DataFrame:
    """``(variable, increasing, decreasing)`` in line order (NULLs skipped).

    Lines are cut into buckets of ``bucket`` rows; inside a bucket a window
    compares each value with the previous one, and the buckets' first and
    last values are compared in a small second step (one row per bucket).
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])
    long = (df.select(F.col(line_col).alias("line"), F.inline(pairs)).where(F.col("x").isNotNull())
            .withColumn("b", F.floor((F.col("line") - 1) / bucket)))
    w = Window.partitionBy("variable", "b").orderBy("line")
    steps = long.withColumn("d", F.col("x") - F.lag("x").over(w))
    per_bucket = steps.groupBy("variable", "b").agg(
        F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") > 0).alias("up"),
        F.min_by("x", "line").alias("first"), F.max_by("x", "line").alias("last"))
    wb = Window.partitionBy("variable").orderBy("b")
    edges = per_bucket.withColumn("d", F.col("first") - F.lag("last").over(wb))
    return edges.groupBy("variable").agg(
        ((F.sum("down") == 0) & (F.count_if(F.col("d") < 0) == 0)).alias("increasing"),
        ((F.sum("up") == 0) & (F.count_if(F.col("d") > 0) == 0)).alias("decreasing"))


def text_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, n_distinct, missing, empty, min_length, max_length, mean_length)`` of text
    columns, one aggregate; distinct values by a bounded sketch."""
    aggs = []
    for c in cols:
        n = F.length(c)
        aggs += [F.approx_count_distinct(c).alias(f"{c}__nd"), F.count_if(F.col(c).isNull()).alias(f"{c}__m"),
                 F.count_if(F.col(c) == "").alias(f"{c}__e"), F.min(n).alias(f"{c}__lo"), F.max(n).alias(f"{c}__hi"),
                 F.avg(n).alias(f"{c}__mean")]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(f"{c}__nd").alias("n_distinct"), F.col(f"{c}__m").alias("missing"),
        F.col(f"{c}__e").alias("empty"), F.col(f"{c}__lo").alias("min_length"), F.col(f"{c}__hi").alias("max_length"),
        F.col(f"{c}__mean").alias("mean_length")) for c in cols])))


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, value, n, share, is_top)``: value counts with their share
    of non-NULL rows; ``is_top`` marks the most frequent value (ties: the
    smallest text).  Totals and tops are one row per column, joined back by
    broadcast: no window spans all distinct values of a column."""
    vc = value_counts(df, cols)
    tops = _tops(vc)
    return (vc.join(F.broadcast(tops), "variable")
            .select("variable", "value", "n", (F.col("n") / F.col("total")).alias("share"),
                    (F.col("value") == F.col("top")).alias("is_top")))


def _tops(vc: DataFrame) -> DataFrame:
    """Per column: non-NULL total, distinct count, top frequency and value."""
    per = vc.groupBy("variable").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_distinct"),
                                     F.max("n").alias("freq"))
    top = (vc.join(F.broadcast(per.select("variable", "freq")), "variable").where(F.col("n") == F.col("freq"))
           .groupBy("variable").agg(F.min("value").alias("top")))
    return per.join(top, "variable")


def categorical_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, n_distinct, top, freq, missing)``."""
    tops = _tops(value_counts(df, cols))
    miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    miss = miss.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing"))
                                          for c in cols])))
    return tops.select("variable", "n_distinct", "top", "freq").join(miss, "variable")


def datetime_profile(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """``(variable, min, max, range_seconds, n_distinct, missing)``."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("timestamp_ntz").alias(f"{c}__min"), F.max(c).cast("timestamp_ntz").alias(f"{c}__max"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__missing")]
    stats = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                     # zone-free difference of the NTZ values, in seconds
                     (F.expr(f"timestampdiff(MICROSECOND, `{c}__min`, `{c}__max`)") / 1e6).alias("range_seconds"),
                     F.col(f"{c}__missing").alias("missing")) for c in cols]
    out = stats.select(F.inline(F.array(*rows)))
    return out.join(distinct_counts(df, cols, exact).drop("n_unique"), "variable", "left")


def boolean_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, n_true, n_false, missing)``."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c) == F.lit(True)).alias(f"{c}__t"),
                 F.count_if(F.col(c) == F.lit(False)).alias(f"{c}__f"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__m")]
    stats = df.agg(*aggs)
    return stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"{c}__t").alias("n_true"),
                                                    F.col(f"{c}__f").alias("n_false"),
                                                    F.col(f"{c}__m").alias("missing")) for c in cols])))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between each column's least and greatest finite value:
    ``(variable, bin, lower, upper, n)``; the greatest falls in the last bin."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.inline(pairs)).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    bounds = long.groupBy("variable").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)))
    counted = (long.join(F.broadcast(bounds), "variable")   # one row per column
               .groupBy("variable", b.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n")))
    return counted.select("variable", "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
                          (F.col("lo") + F.col("bin") * width).alias("upper"), "n")


ROLE_NUMERIC = ("integer", "double")


def column_roles(entity: Entity) -> dict[str, list[str]]:
    """Profile role per variable: categorical (declared ``Categorical``),
    numeric, datetime, boolean, text."""
    roles: dict[str, list[str]] = {"categorical": [], "numeric": [], "datetime": [], "boolean": [], "text": []}
    for v in entity.variables:
        if v.is_categorical:
            roles["categorical"].append(v.label)
        elif v.fmt in ROLE_NUMERIC:
            roles["numeric"].append(v.label)
        elif v.fmt in ("date", "datetime"):
            roles["datetime"].append(v.label)
        elif v.fmt == "boolean":
            roles["boolean"].append(v.label)
        else:
            roles["text"].append(v.label)
    return roles


def overview(df: DataFrame, entity: Entity) -> DataFrame:
    """Table level: rows, columns, missing cells and share, column roles."""
    roles = column_roles(entity)
    labels = entity.labels
    missing = sum((F.count_if(F.col(c).isNull()) for c in labels[1:]), F.count_if(F.col(labels[0]).isNull()))
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("missing_cells"))
    ncols = len(labels)
    return stats.select(
        F.lit(entity.name).alias("entity"), "n_rows", F.lit(ncols).alias("n_columns"), "missing_cells",
        F.when(F.col("n_rows") > 0, F.col("missing_cells") / (F.col("n_rows") * ncols)).alias("missing_share"),
        *[F.lit(len(v)).alias(f"n_{k}") for k, v in roles.items()])
