"""Entity validation: row and NULL counts, boolean rules, catalog checks.

Plan shape per entity (instead of one query per check):

* one fused aggregate: ``count(*)``, a NULL count per variable and a pass
  count per rule, all in a single scan with map-side partial aggregation;
* one violation stream: every failing (row, rule) and every non-NULL catalog
  value exploded into ``(kind, check, value, line)`` and anti-joined once
  against the union of all code lists (broadcast after a size check);
* bounded reports from that stream: first lines per check by a window group
  limit, first distinct values per check from a per-value partial aggregate;
* a table without stored line numbers is not sorted for them: the lines a report
  names are found by their order and numbered by counting the rows before them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.casting import canonical_text, try_parse
from tessera.model import Entity, Rule
from tessera.operators.common import BROADCAST_MAX_ROWS, broadcast_checked, first_n, with_tail
from tessera.session import write_read

# How many lines / values a report lists before "+k lines".
REPORT_LINES = 10
REPORT_VALUES = 10


@dataclass(frozen=True)
class RuleCheck:
    index: int
    expression: str
    column: Column | None   # None when the rule does not analyse
    error: str | None


def analyse_rules(df: DataFrame, rules: Sequence[Rule | str]) -> list[RuleCheck]:
    """Resolve each rule alone against the schema (no job runs).

    A rule that does not parse, names an unknown column or is not boolean is
    marked with its error and left out of the fused plan.
    """
    out = []
    for i, r in enumerate(rules):
        text = r.expression if isinstance(r, Rule) else r
        try:
            col = F.expr(text)
            dtype = df.select(col.alias("r")).schema["r"].dataType
            if not isinstance(dtype, T.BooleanType):
                raise TypeError(f"rule is {dtype.simpleString()}, not boolean")
            out.append(RuleCheck(i, text, col, None))
        except (PySparkException, TypeError, ValueError) as e:
            out.append(RuleCheck(i, text, None, str(e).splitlines()[0]))
    return out


def fused_counts(df: DataFrame, labels: Sequence[str], rules: Sequence[RuleCheck],
                 catalogs: Sequence["CatalogCheck"] = ()) -> DataFrame:
    """One row: ``total``, ``na_<i>`` per label, ``pass_<j>`` per usable rule,
    ``cat_<k>`` wrong rows per inlined catalog check."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"na_{i}") for i, c in enumerate(labels)]
    aggs += [F.count_if(F.coalesce(r.column, F.lit(False))).alias(f"pass_{r.index}")
             for r in rules if r.column is not None]
    aggs += [F.count_if(catalog_fail(c)).alias(f"cat_{k}") for k, c in enumerate(catalogs) if c.inline is not None]
    return df.agg(*aggs)


def null_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Long form ``(label_index, label, na_count)`` from the fused aggregate."""
    counts = fused_counts(df, labels, [])
    pairs = F.array(*[F.struct(F.lit(i).alias("label_index"), F.lit(c).alias("label"),
                               F.col(f"na_{i}").alias("na_count")) for i, c in enumerate(labels)])
    return counts.select(F.inline(pairs))


def rule_summary(df: DataFrame, rules: Sequence[Rule | str]) -> DataFrame:
    """Per rule ``(rule_index, expression, total_registries, passed_rule,
    total_wrong_lines, failed)``.  A NULL result counts as wrong; a rule that
    does not analyse passes 0 and is wrong on every row."""
    checks = analyse_rules(df, rules)
    counts = fused_counts(df, [], checks)
    rows = []
    for r in checks:
        passed = F.col(f"pass_{r.index}") if r.column is not None else F.lit(0).cast("long")
        rows.append(F.struct(F.lit(r.index).alias("rule_index"), F.lit(r.expression).alias("expression"),
                             F.col("total").alias("total_registries"), passed.alias("passed_rule"),
                             (F.col("total") - passed).alias("total_wrong_lines"),
                             F.lit(r.column is None).alias("failed")))
    return counts.select(F.inline(F.array(*rows)))


# The engine's error conditions that an expression over good data
# can raise.  Anything else (a missing file, a lost executor) is no rule's fault.
RULE_ERRORS = ("DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "INTERVAL_DIVIDED_BY_ZERO", "ARITHMETIC_OVERFLOW",
               "BINARY_ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "NUMERIC_OUT_OF_SUPPORTED_RANGE",
               "CAST_INVALID_INPUT", "CAST_OVERFLOW", "CANNOT_PARSE_TIMESTAMP", "CANNOT_PARSE_DECIMAL",
               "INVALID_ARRAY_INDEX", "INVALID_ARRAY_INDEX_IN_ELEMENT_AT", "INVALID_INDEX_OF_ZERO", "DATETIME_OVERFLOW",
               "INVALID_BOOLEAN_STATEMENT", "INVALID_PARAMETER_VALUE", "USER_RAISED_EXCEPTION", "REGEX_GROUP_INDEX")


def is_rule_error(e: PySparkException) -> bool:
    condition = e.getCondition() or ""
    return condition.split(".")[0] in RULE_ERRORS


def runtime_safe_rules(df: DataFrame, checks: list[RuleCheck]) -> list[RuleCheck]:
    """Run the fused count; if it raises at run time (e.g. ANSI division by
    zero), find the rules that raise by halving and mark them.  The actions
    return one row each."""
    usable = [r for r in checks if r.column is not None]
    try:
        fused_counts(df, [], usable).collect()
        return checks
    except PySparkException as e:
        if not is_rule_error(e):
            raise
        return _isolate(df, checks)


# ----------------------------------------------------------------- catalogs
# Code lists up to this many codes are checked with an in-set predicate (a
# hash set shipped inside the plan) instead of a join.
INLINE_CODES_MAX = 10_000


@dataclass(frozen=True)
class CatalogCheck:
    variable: str
    fmt: str
    codes: DataFrame       # catalog rows
    code_column: str = "code"
    max_rows: int | None = None   # known bound on the code list, if any
    inline: tuple[str, ...] | None = None   # canonical codes, when small


def value_text(c: CatalogCheck) -> Column:
    return canonical_text(F.col(c.variable), c.fmt)


def inline_small_catalogs(checks: Sequence[CatalogCheck], limit: int = INLINE_CODES_MAX) -> list[CatalogCheck]:
    """Resolve code lists of at most ``limit`` codes (proven by a bounded
    count) to their canonical texts; larger lists stay as DataFrames and
    are checked by an anti join."""
    out = []
    for c in checks:
        codes = catalog_codes([c])
        rows = codes.limit(limit + 1).collect()
        if len(rows) <= limit:
            c = CatalogCheck(c.variable, c.fmt, c.codes, c.code_column, len(rows),
                             tuple(sorted(r["value"] for r in rows)))
        out.append(c)
    return out


def catalog_fail(c: CatalogCheck) -> Column:
    """Row predicate of an inlined catalog check: non-NULL and not a code."""
    v = F.col(c.variable)
    if not c.inline:
        return v.isNotNull()
    return v.isNotNull() & ~value_text(c).isin(*c.inline)


def catalog_codes(checks: Sequence[CatalogCheck]) -> DataFrame | None:
    """Union of all code lists as ``(check, value)`` text keys.

    Codes are parsed to the variable's type and printed back, so ``3``,
    ``3.0`` and ``03`` of a catalog all meet the integer 3; NULL and blank
    codes match nothing.
    """
    parts = []
    for c in checks:
        typed = try_parse(F.trim(F.col(c.code_column).cast("string")), c.fmt)
        parts.append(c.codes.select(F.lit(c.variable).alias("check"),
                                    canonical_text(typed, c.fmt).alias("value"))
                     .where(F.col("value").isNotNull()))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def violation_stream(df: DataFrame, line_col: str | Column, rules: Sequence[RuleCheck] = (),
                     catalogs: Sequence[CatalogCheck] = ()) -> DataFrame:
    """``(kind, check, value, line)`` for every failing rule row and every
    non-NULL value outside its catalog; one scan.  ``line_col`` names the line
    number; another place of a row is given as a column and stays as it is.  Inlined code lists are a
    set-membership predicate; the others meet one anti join against the
    union of their code lists (broadcast when the size is known or proven)."""
    items = []
    for r in rules:
        if r.column is None:
            continue
        items.append(F.when(~F.coalesce(r.column, F.lit(False)),
                            F.struct(F.lit("rule").alias("kind"), F.lit(str(r.index)).alias("check"),
                                     F.lit(None).cast("string").alias("value"))))
    for c in catalogs:
        items.append(F.when(catalog_fail(c),
                            F.struct(F.lit("catalog").alias("kind"), F.lit(c.variable).alias("check"),
                                     value_text(c).alias("value"))))
    if not items:
        schema = "kind string, check string, value string, line long"
        return df.sparkSession.createDataFrame([], schema)
    line = F.col(line_col).cast("long") if isinstance(line_col, str) else line_col
    stream = (df.select(line.alias("line"),
                        F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
              .select("kind", "check", "value", "line"))
    joined = [c for c in catalogs if c.inline is None]
    codes = catalog_codes(joined)
    if codes is None:
        return stream
    bounds = [c.max_rows for c in joined]
    if all(b is not None for b in bounds) and sum(bounds) <= BROADCAST_MAX_ROWS:
        cond = (stream["check"] == codes["check"]) & (stream["value"] == codes["value"])
        return stream.join(F.broadcast(codes), cond, "left_anti")   # size known from the code lists
    # a large code list: values first.  Distinct (check, value) candidates
    # (a partial aggregate, so a value held by many rows is one row) meet the
    # codes; only the wrong pairs go back to the rows, broadcast when small.
    # Rule rows carry no value and pass the join by.
    listed = stream.where(F.col("kind") == "catalog")
    wrong = broadcast_checked(listed.select("check", "value").distinct().join(codes, ["check", "value"], "left_anti"))
    marked = listed.join(wrong, ["check", "value"], "left_semi")
    return stream.where(F.col("kind") == "rule").unionByName(marked.select(*stream.columns)).select(
        "kind", "check", "value", "line")


def check_lines(stream: DataFrame, n: int = REPORT_LINES) -> DataFrame:
    """Per (kind, check): total wrong lines and the first ``n`` as text."""
    totals = stream.groupBy("kind", "check").agg(F.count(F.lit(1)).alias("total_wrong_lines"))
    firsts = first_n(stream, ["kind", "check"], "line", F.col("line").cast("string"), n, "lines")
    return (totals.join(firsts, ["kind", "check"], "left")
            .select("kind", "check", "total_wrong_lines",
                    with_tail(F.coalesce("lines", F.array().cast("array<string>")),
                              F.col("total_wrong_lines"), n, "lines").alias("wrong_lines")))


# ------------------------------------------------------------- the report
RESULT_SCHEMA = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("total_registries", T.LongType()),
    T.StructField("na_count_list", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("na_count", T.LongType())]))),
    T.StructField("catalog_checking", T.ArrayType(T.StructType([
        T.StructField("variable", T.StringType()),
        T.StructField("wrong_values", T.ArrayType(T.StringType())),
        T.StructField("wrong_lines", T.ArrayType(T.StringType())),
        T.StructField("total_wrong_lines", T.LongType())]))),
    T.StructField("rules", T.ArrayType(T.StructType([
        T.StructField("expression", T.StringType()),
        T.StructField("passed_rule", T.LongType()),
        T.StructField("wrong_lines", T.ArrayType(T.StringType())),
        T.StructField("total_wrong_lines", T.LongType())]))),
])


def catalog_checks_for(entity: Entity, catalogs: Mapping[str, DataFrame],
                       sizes: Mapping[str, int] | None = None, inline: bool = True) -> list[CatalogCheck]:
    """Catalog checks of an entity; ``catalogs`` maps variable label (or the
    catalog file name) to a DataFrame of the code list; ``sizes`` may give
    known row counts of those lists.  With ``inline``, small code lists are
    resolved to in-set predicates (see :func:`inline_small_catalogs`)."""
    out = []
    for v in entity.variables:
        if not v.checks_catalog:
            continue
        codes = catalogs.get(v.label)
        if codes is None and v.catalog is not None:
            codes = catalogs.get(v.catalog.filename)
        if codes is None:
            raise KeyError(f"no catalog for {entity.name}.{v.label}")
        out.append(CatalogCheck(v.label, v.fmt, codes, v.catalog.column_name if v.catalog else "code",
                                (sizes or {}).get(v.label)))
    return inline_small_catalogs(out) if inline else out


def check_report(stream: DataFrame, n_lines: int = REPORT_LINES, n_values: int = REPORT_VALUES) -> DataFrame:
    """Per (kind, check): ``total_wrong_lines``, ``wrong_lines`` (first
    ``n_lines`` + tail), ``n_wrong_values`` and ``wrong_values`` (first
    ``n_values`` distinct by first appearance + tail).

    Two passes over the stream: the first lines through a window group
    limit, and a per-(check, value) partial aggregate that yields totals,
    distinct counts and first values."""
    firsts = first_n(stream, ["kind", "check"], "line", F.col("line").cast("string"), n_lines, "lines")
    per_value = stream.groupBy("kind", "check", "value").agg(F.count(F.lit(1)).alias("n"),
                                                            F.min("line").alias("first_line"))
    # both consumers read every column of per_value and no filter is pushed
    # below it, so its shuffle is planned once and reused
    sums = per_value.groupBy("kind", "check").agg(F.sum("n").alias("total_wrong_lines"),
                                                  F.count("value").alias("n_wrong_values"),
                                                  F.min("first_line").alias("first_wrong_line"))
    vals = first_n(per_value, ["kind", "check"], "first_line", F.struct("value", "n"), n_values, "values")
    vals = vals.select("kind", "check", F.filter(F.transform("values", lambda v: v["value"]),
                                                 lambda x: x.isNotNull()).alias("values"))
    return _joined_report(sums, firsts, vals, n_lines, n_values)


def _joined_report(sums: DataFrame, firsts: DataFrame, vals: DataFrame, n_lines: int, n_values: int) -> DataFrame:
    empty = F.array().cast("array<string>")
    return (sums.join(firsts, ["kind", "check"], "left").join(vals, ["kind", "check"], "left")
            .select("kind", "check", "total_wrong_lines",
                    with_tail(F.coalesce("lines", empty), F.col("total_wrong_lines"), n_lines, "lines")
                    .alias("wrong_lines"), "n_wrong_values",
                    with_tail(F.coalesce("values", empty), F.col("n_wrong_values"), n_values, "values")
                    .alias("wrong_values")))


def first_rows(df: DataFrame, order_col: str, rules: Sequence[RuleCheck], catalogs: Sequence[CatalogCheck],
               n: int = REPORT_LINES) -> DataFrame:
    """``(kind, check, line, id)``: the first ``n`` wrong rows of each check in the order of the struct
    ``order_col``, their place as ``line``; stored, at most ``n`` rows a check.

    A bounded top list per check and task: the rows are neither sorted nor shuffled."""
    out = None
    for rule, cat in [((r,), ()) for r in rules] + [((), (c,)) for c in catalogs]:
        part = violation_stream(df, F.col(order_col), rule, cat).select("kind", "check", "line").orderBy("line").limit(n)
        out = part if out is None else out.unionByName(part)
    return write_read(out.withColumn("id", F.monotonically_increasing_id()), "first-rows")


def line_numbers_of(df: DataFrame, order_col: str, rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`first_rows` with the ``line_number`` that
    :func:`tessera.operators.common.number_rows` gives them in the order of ``order_col``.

    A line number is the count of rows before the row plus its place among equal rows (all of
    which fail the same checks).  One scan; only counts are shuffled."""
    here = df.select(F.col(order_col).alias("_row"))
    last = F.broadcast(rows.agg(F.max("line").alias("_last")))                 # one row; most rows lie behind it
    places = F.broadcast(rows.select("id", F.col("line").alias("_place")))     # as many rows as a report names
    before = (here.join(last, F.col("_row") < F.col("_last")).join(places, F.col("_row") < F.col("_place"))
              .groupBy("id").agg(F.count(F.lit(1)).alias("_before")))
    among = F.row_number().over(Window.partitionBy("kind", "check", "line").orderBy("id"))
    return (rows.join(before, "id", "left")
            .select("kind", "check", (F.coalesce("_before", F.lit(0)) + among).cast("long").alias("line_number")))


def ordered_report(df: DataFrame, order_col: str, rules: Sequence[RuleCheck], catalogs: Sequence[CatalogCheck],
                   n_lines: int = REPORT_LINES, n_values: int = REPORT_VALUES) -> DataFrame:
    """:func:`check_report` of a table without line numbers, whose rows stand in the order of the
    struct ``order_col`` (a total order).

    Totals and values come from one partial aggregate that keeps each value's smallest leading
    order field; only values that can be among the first ``n_values`` by it are looked up
    again, in the rows that hold it, to be put in their full order."""
    rules = [r for r in rules if r.column is not None]
    if not rules and not catalogs:
        return check_report(violation_stream(df, F.col(order_col)), n_lines, n_values)
    lead = df.schema[order_col].dataType.fields[0].name
    per_value = (violation_stream(df, F.col(order_col)[lead], rules, catalogs).groupBy("kind", "check", "value")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("_min"), F.count("line").alias("_given")))
    # a NULL comes first in the order
    per_value = write_read(per_value.select("kind", "check", "value", "n", F.when(F.col("_given") == F.col("n"), F.col("_min"))
                                            .alias("_lead")), "wrong-values")
    sums = per_value.groupBy("kind", "check").agg(F.sum("n").alias("total_wrong_lines"),
                                                  F.count("value").alias("n_wrong_values"))
    lines = line_numbers_of(df, order_col, first_rows(df, order_col, rules, catalogs, n_lines))
    firsts = first_n(lines, ["kind", "check"], "line_number", F.col("line_number").cast("string"), n_lines, "lines")
    if not catalogs:
        none = per_value.select("kind", "check", F.array("value").alias("values")).where(F.lit(False))
        return _joined_report(sums, firsts, none, n_lines, n_values)
    near = broadcast_checked(per_value.where("value IS NOT NULL")
                             .withColumn("_rank", F.rank().over(Window.partitionBy("kind", "check").orderBy("_lead")))
                             .where(F.col("_rank") <= n_values).select("check", "value", "_lead"))
    listed = violation_stream(df, F.col(order_col), (), catalogs).alias("s")
    first = (listed.join(near.alias("v"), F.expr("s.check = v.check AND s.value = v.value")
                         & F.col(f"s.line.`{lead}`").eqNullSafe(F.col("v._lead")))
             .groupBy("s.kind", "s.check", "s.value").agg(F.min("s.line").alias("first")))
    vals = first_n(first, ["kind", "check"], "first", "value", n_values, "values")
    return _joined_report(sums, firsts, vals, n_lines, n_values)


def catalog_report(df: DataFrame, checks: Sequence[CatalogCheck], line_col: str = "line_number",
                   stream: DataFrame | None = None) -> DataFrame:
    """One row per catalog check, zeros included: ``(cat_index, variable,
    total_wrong_lines, n_wrong_values, wrong_lines, wrong_values)``."""
    spark = df.sparkSession
    if stream is None:
        stream = violation_stream(df, line_col, (), checks)
    rep = check_report(stream).where(F.col("kind") == "catalog")
    meta = spark.createDataFrame([(i, c.variable) for i, c in enumerate(checks)], "cat_index int, variable string")
    empty = F.array().cast("array<string>")
    return (meta.join(rep.withColumnRenamed("check", "variable"), "variable", "left")
            .select("cat_index", "variable",
                    F.coalesce("total_wrong_lines", F.lit(0).cast("long")).alias("total_wrong_lines"),
                    F.coalesce("n_wrong_values", F.lit(0).cast("long")).alias("n_wrong_values"),
                    F.coalesce("wrong_lines", empty).alias("wrong_lines"),
                    F.coalesce("wrong_values", empty).alias("wrong_values")))


def _raises(df: DataFrame, rules: Sequence[RuleCheck]) -> str | None:
    """The first line of the error that counting these rules together raises, or None.  One scan."""
    try:
        df.agg(*[F.count_if(F.coalesce(r.column, F.lit(False))).alias(f"pass_{r.index}") for r in rules]).collect()
        return None
    except PySparkException as e:
        if not is_rule_error(e):
            raise
        return str(e).splitlines()[0]


def _faulty(df: DataFrame, rules: Sequence[RuleCheck], known: bool) -> dict[int, str]:
    """Errors of the rules that raise, by halving: a group that counts without error is cleared at once.

    ``known`` says that some rule of the group raises.  f raising rules among R take about
    2 f log2(R) scans, and a scan that raises ends early."""
    if len(rules) == 1 or not known:
        error = _raises(df, rules)
        if error is None:
            return {}
        if len(rules) == 1:
            return {rules[0].index: error}
    half = len(rules) // 2
    left = _faulty(df, rules[:half], False)
    # if the first half is clear the fault lies in the second, which then needs no test as a whole
    return {**left, **_faulty(df, rules[half:], not left)}


def _isolate(df: DataFrame, checks: list[RuleCheck]) -> list[RuleCheck]:
    """Mark the rules that raise at run time; called when all together did."""
    usable = [r for r in checks if r.column is not None]
    errors = _faulty(df, usable, True) if usable else {}
    return [RuleCheck(r.index, r.expression, None, errors[r.index]) if r.index in errors else r for r in checks]


def validate_entity(df: DataFrame, entity: Entity, catalogs: Mapping[str, DataFrame] | None = None,
                    line_col: str = "line_number", isolate_runtime_errors: bool = True,
                    catalog_sizes: Mapping[str, int] | None = None, order_col: str | None = None) -> DataFrame:
    """The nested validation record of one entity (one row, ``RESULT_SCHEMA``).

    ``df`` is the staged entity with a stored ``line_col``, or with the struct ``order_col``
    whose order its lines follow (see :func:`ordered_report`).  The fused count
    (rows, NULLs per variable, passes per rule, wrong rows per small catalog)
    runs once here and returns one row; it is also the probe for rules that
    raise at run time, which are then found by halving the set of rules.
    Such rules, and rules that do not analyse, are reported as passing 0
    rows, wrong on all, with the text ``"<n> lines"``.  Wrong lines and
    values stay lazy with a ``line_col``: one more aggregate over the violation stream.
    """
    spark = df.sparkSession
    labels = entity.labels
    checks = analyse_rules(df, entity.rules)
    cats = catalog_checks_for(entity, catalogs or {}, catalog_sizes)
    try:
        row = fused_counts(df, labels, checks, cats).first()
    except PySparkException as e:
        if not (isolate_runtime_errors and is_rule_error(e)):
            raise
        checks = _isolate(df, checks)
        row = fused_counts(df, labels, checks, cats).first()
    total = int(row["total"])
    if order_col is None:
        report = check_report(violation_stream(df, line_col, checks, cats))
    else:
        report = ordered_report(df, order_col, checks, cats)

    # what is known on the driver: one row per rule and per catalog check
    meta_rows = []
    for r in checks:
        if r.column is None:
            meta_rows.append(("rule", r.index, "rule", str(r.index), r.expression, 0, total, [f"{total} lines"]))
        else:
            p = int(row[f"pass_{r.index}"])
            meta_rows.append(("rule", r.index, "rule", str(r.index), r.expression, p, total - p, None))
    for k, c in enumerate(cats):
        meta_rows.append(("catalog", k, "catalog", c.variable, c.variable, None, None, None))
    meta = spark.createDataFrame(meta_rows, "part string, idx int, kind string, check string, name string, "
                                            "passed long, wrong long, fixed_lines array<string>")
    empty = F.array().cast("array<string>")
    j = meta.join(report, ["kind", "check"], "left")
    rule_struct = F.struct(F.col("name").alias("expression"), F.col("passed").alias("passed_rule"),
                           F.coalesce("fixed_lines", "wrong_lines", empty).alias("wrong_lines"),
                           F.col("wrong").alias("total_wrong_lines"))
    cat_struct = F.struct(F.col("name").alias("variable"), F.coalesce("wrong_values", empty).alias("wrong_values"),
                          F.coalesce("wrong_lines", empty).alias("wrong_lines"),
                          F.coalesce("total_wrong_lines", F.lit(0).cast("long")).alias("total_wrong_lines"))

    def ordered(part, value):
        picked = F.collect_list(F.when(F.col("part") == part, F.struct(F.col("idx"), value.alias("v"))))
        return F.transform(F.array_sort(picked), lambda s: s["v"])

    na_list = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(int(row[f"na_{i}"])).cast("long").alias("na_count"))
                        for i, c in enumerate(labels)])
    # one aggregate gathers both bounded lists; the head columns are known
    return (j.agg(ordered("catalog", cat_struct).alias("catalog_checking"), ordered("rule", rule_struct).alias("rules"))
            .select(F.lit(entity.name).alias("entity"), F.lit(total).cast("long").alias("total_registries"),
                    na_list.alias("na_count_list"), "catalog_checking", "rules")
            .select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields]))
