"""Registered queries over the driver tables, each with its oracle SQL.

Every query reads whole driver tables (or data Spark derives from them) and
returns a lazy DataFrame.  The oracle next to it is plain SQL on the same
tables; both alias every column to the same name.  Lists are returned as
text joined with ``", "`` so results compare as flat rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.model import Entity, ForeignKey, Variable
from tessera.operators import audit as AU
from tessera.operators import keys as K
from tessera.operators import logs as LG
from tessera.operators import profile as PR
from tessera.operators import publish as P
from tessera.operators import status as ST
from tessera.operators import validate as V
from tessera.operators.common import file_line_numbers
from tessera.plans import driver_model as M
from tessera.plans import ingest as IG
from tessera.plans import intake as IN
from tessera.plans import report as RP
from tessera.session import scratch_path as _scratch
from tessera.sources import delimited as DL
from tessera.sources import files as FS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def joined(col) -> F.Column:
    return F.array_join(col, ", ")


# ---------------------------------------------------------------- helpers
def _not_passing(rule: str) -> str:
    return f"NOT coalesce(({rule}), false)"


def _rule_violation_sql(view: str, rules: list[str]) -> str:
    parts = [f"SELECT {i} AS rule_index, line_number FROM v WHERE {_not_passing(r)}" for i, r in enumerate(rules)]
    return f"WITH v AS ({view}) " + " UNION ALL ".join(parts)


def _first_lines_sql(src: str, key: str, n: int = 10) -> str:
    """``src`` has (key, line_number); first n lines joined + tail."""
    return (f"SELECT {key}, CAST(max(cnt) AS BIGINT) AS total_wrong_lines, "
            f"string_agg(CAST(line_number AS VARCHAR), ', ' ORDER BY line_number) || "
            f"CASE WHEN max(cnt) > {n} THEN ', +' || CAST(max(cnt) - {n} AS VARCHAR) || ' lines' ELSE '' END "
            f"AS wrong_lines FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line_number) AS rn, "
            f"count(*) OVER (PARTITION BY {key}) AS cnt FROM ({src})) WHERE rn <= {n} GROUP BY {key}")


# -------------------------------------------------------- A2 null counts
def _null_counts_sql(view: str, labels: list[str]) -> str:
    parts = [f"SELECT {i} AS label_index, '{c}' AS label, CAST(count_if({c} IS NULL) AS BIGINT) AS na_count FROM v"
             for i, c in enumerate(labels)]
    return f"WITH v AS ({view}) " + " UNION ALL ".join(parts)


@query("null_counts", _null_counts_sql(M.LINEITEM_SQL, M.LINEITEM.labels))
def q_null_counts(spark, d):
    return V.null_counts(M.lineitem_view(spark, d), M.LINEITEM.labels)


# ------------------------------------------------------ A3 rule summary
def _rule_summary_sql(view: str, rules: list[str]) -> str:
    aggs = ", ".join(f"count_if(coalesce(({r}), false)) AS p{i}" for i, r in enumerate(rules))
    parts = [f"SELECT {i} AS rule_index, '{r}' AS expression, CAST(total AS BIGINT) AS total_registries, "
             f"CAST(p{i} AS BIGINT) AS passed_rule, CAST(total - p{i} AS BIGINT) AS total_wrong_lines FROM c"
             for i, r in enumerate(rules)]
    return f"WITH v AS ({view}), c AS (SELECT count(*) AS total, {aggs} FROM v) " + " UNION ALL ".join(parts)


@query("rule_summary", _rule_summary_sql(M.LINEITEM_SQL, M.LINEITEM_RULES))
def q_rule_summary(spark, d):
    return V.rule_summary(M.lineitem_view(spark, d), M.LINEITEM_RULES).drop("failed")


# --------------------------------------------- A4 rules that cannot run
def _rule_error_sql() -> str:
    ok = {0: M.ERROR_RULES[0], 3: M.ERROR_RULES[3]}
    aggs = ", ".join(f"count_if(coalesce(({r}), false)) AS p{i}" for i, r in ok.items())
    parts = []
    for i, r in enumerate(M.ERROR_RULES):
        rq = r.replace("'", "''")
        if i in ok:
            parts.append(f"SELECT {i} AS rule_index, '{rq}' AS expression, CAST(p{i} AS BIGINT) AS passed_rule, "
                         f"CAST(total - p{i} AS BIGINT) AS total_wrong_lines, false AS failed FROM c")
        else:
            parts.append(f"SELECT {i} AS rule_index, '{rq}' AS expression, CAST(0 AS BIGINT) AS passed_rule, "
                         f"CAST(total AS BIGINT) AS total_wrong_lines, true AS failed FROM c")
    return f"WITH v AS ({M.LINEITEM_SQL}), c AS (SELECT count(*) AS total, {aggs} FROM v) " + " UNION ALL ".join(parts)


@query("rule_error_fallback", _rule_error_sql())
def q_rule_error_fallback(spark, d):
    df = M.lineitem_view(spark, d)
    checks = V.runtime_safe_rules(df, V.analyse_rules(df, M.ERROR_RULES))
    counts = V.fused_counts(df, [], checks)
    rows = []
    for r in checks:
        passed = F.col(f"pass_{r.index}") if r.column is not None else F.lit(0).cast("long")
        rows.append(F.struct(F.lit(r.index).alias("rule_index"), F.lit(r.expression).alias("expression"),
                             passed.alias("passed_rule"),
                             F.when(F.lit(r.column is None), F.col("total"))
                              .otherwise(F.col("total") - passed).alias("total_wrong_lines"),
                             F.lit(r.column is None).alias("failed")))
    return counts.select(F.inline(F.array(*rows)))


# ------------------------------------------------ J2 rule violations
@query("rule_violations", _rule_violation_sql(M.LINEITEM_LINES_SQL, M.LINEITEM_RULES))
def q_rule_violations(spark, d):
    df = M.lineitem_lines(spark, d)
    stream = V.violation_stream(df, "line_number", V.analyse_rules(df, M.LINEITEM_RULES))
    return stream.select(F.col("check").cast("int").alias("rule_index"), F.col("line").alias("line_number"))


@query("rule_first10", _first_lines_sql(_rule_violation_sql(M.LINEITEM_LINES_SQL, M.LINEITEM_RULES), "rule_index"))
def q_rule_first10(spark, d):
    df = M.lineitem_lines(spark, d)
    stream = V.violation_stream(df, "line_number", V.analyse_rules(df, M.LINEITEM_RULES))
    return V.check_lines(stream).select(F.col("check").cast("int").alias("rule_index"), "total_wrong_lines",
                                        joined("wrong_lines").alias("wrong_lines"))


# --------------------------------------------------- J1 catalog checks
CATALOG_ENTITIES = [
    ("orders", M.ORDERS, M.orders_lines, M.ORDERS_LINES_SQL, "o_orderpriority",
     f"SELECT * FROM (VALUES {', '.join('(' + repr(c) + ')' for c in M.PRIORITY_CODES)}) t(code)"),
    ("lineitem", M.LINEITEM, M.lineitem_lines, M.LINEITEM_LINES_SQL, "l_returnflag",
     f"SELECT * FROM (VALUES {', '.join('(' + repr(c) + ')' for c in M.RETURNFLAG_CODES)}) t(code)"),
    ("events", M.EVENTS, M.events_lines, M.EVENTS_LINES_SQL, "event_type",
     f"SELECT * FROM (VALUES {', '.join('(' + repr(c) + ')' for c in M.EVENT_TYPE_CODES)}) t(code)"),
    ("nation", M.NATION, M.nation_lines, M.NATION_LINES_SQL, "n_regionkey",
     "SELECT r_regionkey AS code FROM region"),
]


def _catalog_streams(spark, d):
    for name, ent, lines_fn, _, var, _ in CATALOG_ENTITIES:
        df = lines_fn(spark, d)
        checks = V.catalog_checks_for(ent, M.catalogs_for(spark, d, name), M.catalog_sizes(name))
        yield name, df, checks


def _catalog_violation_sql() -> str:
    parts = []
    for name, _, _, view, var, codes in CATALOG_ENTITIES:
        parts.append(f"SELECT '{name}' AS entity, '{var}' AS variable, v.line_number AS line_number, "
                     f"CAST(v.{var} AS VARCHAR) AS value FROM ({view}) v LEFT JOIN ({codes}) c "
                     f"ON v.{var} = c.code WHERE c.code IS NULL AND v.{var} IS NOT NULL")
    return " UNION ALL ".join(parts)


@query("catalog_violations", _catalog_violation_sql())
def q_catalog_violations(spark, d):
    out = None
    for name, df, checks in _catalog_streams(spark, d):
        s = V.violation_stream(df, "line_number", (), checks).select(
            F.lit(name).alias("entity"), F.col("check").alias("variable"), F.col("line").alias("line_number"),
            "value")
        out = s if out is None else out.unionByName(s)
    return out


def _catalog_first_sql(n: int = 10) -> str:
    viol = _catalog_violation_sql()
    return (f"WITH v AS ({viol}), "
            f"lines AS (SELECT entity, variable, line_number, row_number() OVER (PARTITION BY entity, variable "
            f"ORDER BY line_number) AS rn, count(*) OVER (PARTITION BY entity, variable) AS cnt FROM v), "
            f"l AS (SELECT entity, variable, CAST(max(cnt) AS BIGINT) AS total_wrong_lines, "
            f"string_agg(CAST(line_number AS VARCHAR), ', ' ORDER BY line_number) || CASE WHEN max(cnt) > {n} "
            f"THEN ', +' || CAST(max(cnt) - {n} AS VARCHAR) || ' lines' ELSE '' END AS wrong_lines "
            f"FROM lines WHERE rn <= {n} GROUP BY entity, variable), "
            f"pv AS (SELECT entity, variable, value, min(line_number) AS first_line FROM v GROUP BY ALL), "
            f"vals AS (SELECT *, row_number() OVER (PARTITION BY entity, variable ORDER BY first_line) AS rn, "
            f"count(*) OVER (PARTITION BY entity, variable) AS cnt FROM pv), "
            f"w AS (SELECT entity, variable, CAST(max(cnt) AS BIGINT) AS n_wrong_values, "
            f"string_agg(value, ', ' ORDER BY first_line) || CASE WHEN max(cnt) > {n} "
            f"THEN ', +' || CAST(max(cnt) - {n} AS VARCHAR) || ' values' ELSE '' END AS wrong_values "
            f"FROM vals WHERE rn <= {n} GROUP BY entity, variable) "
            f"SELECT l.entity, l.variable, l.total_wrong_lines, w.n_wrong_values, l.wrong_lines, w.wrong_values "
            f"FROM l JOIN w USING (entity, variable)")


@query("catalog_first10", _catalog_first_sql())
def q_catalog_first10(spark, d):
    out = None
    for name, df, checks in _catalog_streams(spark, d):
        r = (V.catalog_report(df, checks).where(F.col("total_wrong_lines") > 0)
             .select(F.lit(name).alias("entity"), "variable", "total_wrong_lines", "n_wrong_values",
                     joined("wrong_lines").alias("wrong_lines"), joined("wrong_values").alias("wrong_values")))
        out = r if out is None else out.unionByName(r)
    return out


def _catalog_summary_sql() -> str:
    parts = []
    for name, _, _, view, var, codes in CATALOG_ENTITIES:
        parts.append(f"SELECT '{name}' AS entity, '{var}' AS variable, CAST(count(c.code IS NULL AND v.{var} IS NOT NULL"
                     f" OR NULL) AS BIGINT) AS total_wrong_lines, CAST(count(DISTINCT CASE WHEN c.code IS NULL "
                     f"THEN CAST(v.{var} AS VARCHAR) END) AS BIGINT) AS n_wrong_values "
                     f"FROM ({view}) v LEFT JOIN ({codes}) c ON v.{var} = c.code")
    return " UNION ALL ".join(parts)


@query("catalog_summary", _catalog_summary_sql())
def q_catalog_summary(spark, d):
    out = None
    for name, df, checks in _catalog_streams(spark, d):
        r = V.catalog_report(df, checks).select(F.lit(name).alias("entity"), "variable", "total_wrong_lines",
                                                "n_wrong_values")
        out = r if out is None else out.unionByName(r)
    return out


# -------------------------------------------- K5 nested validation record
def validation_records(spark, d):
    """Validation records of the four driver entities; the lines they name are numbered, no table is sorted."""
    out = None
    for name, ent, _, _, _, _ in CATALOG_ENTITIES:
        rec = V.validate_entity(M.ordered_view(spark, d, name), ent, M.catalogs_for(spark, d, name),
                                catalog_sizes=M.catalog_sizes(name), order_col="line_order")
        out = rec if out is None else out.unionByName(rec)
    return out


@query("validation_report")
def q_validation_report(spark, d):
    return validation_records(spark, d)


# ============================================================ keys

LINEITEM_FK = ForeignKey(("l_orderkey",), "orders", ("o_orderkey",))


@query("pk_duplicates",
       "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem "
       "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def q_pk_duplicates(spark, d):
    return K.pk_duplicates(M.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("pk_nulls",
       f"SELECT line_number, l_orderkey, l_linenumber FROM ({M.LINEITEM_LINES_SQL}) "
       "WHERE l_orderkey IS NULL OR l_linenumber IS NULL")
def q_pk_nulls(spark, d):
    return K.pk_nulls(M.lineitem_lines(spark, d), ["l_orderkey", "l_linenumber"])


@query("fk_orphans_staged",
       f"SELECT line_number, l_orderkey FROM ({M.LINEITEM_LINES_SQL}) "
       f"WHERE l_orderkey NOT IN (SELECT o_orderkey FROM ({M.PARENT_SQL})) AND l_orderkey IS NOT NULL")
def q_fk_orphans_staged(spark, d):
    child = M.lineitem_lines(spark, d)
    return K.orphans(child, M.parent_orders(spark, d), LINEITEM_FK).select("line_number", "l_orderkey")


@query("fk_orphans",
       f"SELECT * FROM ({M.LINEITEM_SQL}) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM ({M.PARENT_SQL}))")
def q_fk_orphans(spark, d):
    return K.orphans(M.lineitem_view(spark, d), M.parent_orders(spark, d), LINEITEM_FK)


@query("fk_valid_rows",
       f"SELECT * FROM ({M.LINEITEM_SQL}) WHERE l_orderkey IN (SELECT o_orderkey FROM ({M.PARENT_SQL}))")
def q_fk_valid_rows(spark, d):
    return K.valid_rows(M.lineitem_view(spark, d), M.parent_orders(spark, d), LINEITEM_FK)


@query("fk_split_counts",
       f"SELECT CAST(count_if(l_orderkey NOT IN (SELECT o_orderkey FROM ({M.PARENT_SQL}))) AS BIGINT) AS orphans, "
       f"CAST(count_if(l_orderkey IN (SELECT o_orderkey FROM ({M.PARENT_SQL}))) AS BIGINT) AS valid, "
       f"CAST(count_if(l_orderkey IS NULL) AS BIGINT) AS null_keys, CAST(count(*) AS BIGINT) AS total "
       f"FROM ({M.LINEITEM_SQL})")
def q_fk_split_counts(spark, d):
    """Orphans, valid rows, NULL keys and total in one aggregate over the
    child rows marked by the (broadcast, size-checked) orphan key set."""
    child = M.lineitem_view(spark, d)
    bad = K.broadcast_checked(K.orphan_keys(child, M.parent_orders(spark, d), LINEITEM_FK)
                              .withColumn("_orphan", F.lit(True)))
    marked = child.join(bad, ["l_orderkey"], "left")
    key_null = F.col("l_orderkey").isNull()
    return marked.agg(F.count_if(F.col("_orphan").isNotNull()).alias("orphans"),
                      F.count_if(F.col("_orphan").isNull() & ~key_null).alias("valid"),
                      F.count_if(key_null).alias("null_keys"), F.count(F.lit(1)).alias("total"))


# ======================================================= publish
UPSERT_SOURCE_SQL = (
    "SELECT o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 1000000000 ELSE 0 END AS o_orderkey, o_custkey, "
    "o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice, o_orderdate, "
    "nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P')")
UPSERT_TARGET_SQL = "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')"


def upsert_source(spark, d):
    o = M.table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return o.select(
        (F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", F.lit(1000000000)).otherwise(0))
        .alias("o_orderkey"),
        "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"), "o_orderdate",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"))


def upsert_target(spark, d):
    return M.table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))


@query("upsert_merge",
       f"SELECT * FROM ({UPSERT_SOURCE_SQL}) UNION ALL SELECT * FROM ({UPSERT_TARGET_SQL}) "
       f"WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({UPSERT_SOURCE_SQL}))")
def q_upsert_merge(spark, d):
    return P.upsert(upsert_target(spark, d), upsert_source(spark, d), ["o_orderkey"])


@query("cascade_delete",
       "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN "
       "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_cascade_delete(spark, d):
    deleted = M.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")
    child = M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return P.cascade_delete(child, deleted, ["l_orderkey"], ["o_orderkey"])


# Staged values that must be narrowed at publish: order value in cents as a
# 128-bit integer, document text as a 255-limited string.

RANGE_ENTITY = Entity("staged_values", [
    Variable("o_orderkey", "integer"), Variable("price_cents", "integer"), Variable("o_orderpriority", "string"),
    Variable("doc_text", "string"), Variable("o_totalprice", "double")], [], ("o_orderkey",))


@query("publish_range_check",
       "WITH s AS (SELECT o.o_orderkey, CAST(round(o.o_totalprice * 10000) AS DECIMAL(38,0)) AS price_cents, "
       "o.o_orderpriority, d.text AS doc_text, o.o_totalprice FROM orders o LEFT JOIN documents d "
       "ON d.doc_id = o.o_orderkey) "
       "SELECT 'staged_values' AS entity, 'o_orderkey' AS variable, "
       "CAST(count_if(o_orderkey IS NOT NULL AND TRY_CAST(o_orderkey AS INTEGER) IS NULL) AS BIGINT) "
       "AS n_out_of_range FROM s UNION ALL "
       "SELECT 'staged_values', 'price_cents', CAST(count_if(price_cents IS NOT NULL AND "
       "TRY_CAST(price_cents AS INTEGER) IS NULL) AS BIGINT) FROM s UNION ALL "
       "SELECT 'staged_values', 'o_orderpriority', CAST(count_if(length(o_orderpriority) > 255) AS BIGINT) FROM s "
       "UNION ALL SELECT 'staged_values', 'doc_text', CAST(count_if(length(doc_text) > 255) AS BIGINT) FROM s")
def q_publish_range_check(spark, d):
    o = M.table(spark, d, "orders")
    docs = M.table(spark, d, "documents").select(F.col("doc_id").alias("o_orderkey"), F.col("text").alias("doc_text"))
    staged = (o.join(docs, "o_orderkey", "left")
              .select(F.col("o_orderkey").cast("decimal(38,0)").alias("o_orderkey"),
                      F.round(F.col("o_totalprice") * 10000).cast("decimal(38,0)").alias("price_cents"),
                      "o_orderpriority", "doc_text", "o_totalprice"))
    return P.range_violations(staged, RANGE_ENTITY)


# ======================================================== cast audit


def _audit_sql(mode: str) -> str:
    parts = []
    for c, fmt in M.DIRTY_FORMATS.items():
        t = M.DUCK_TYPES[fmt]
        if mode == "strict":
            cond = f"{c} IS NOT NULL AND {c} NOT IN ('NA', '') AND TRY_CAST({c} AS {t}) IS NULL"
            parts.append(f"SELECT '{c}' AS variable, line_number, {c} AS value FROM v WHERE {cond}")
        else:
            x = f"nullif({c}, '')"
            back = f"CAST(TRY_CAST({x} AS {t}) AS VARCHAR)"
            cond = f"{back} != {x} OR ({back} = {x}) IS NULL"
            parts.append(f"SELECT '{c}' AS variable, line_number, {c} AS value FROM v WHERE {cond}")
    return f"WITH v AS ({M.DIRTY_ORDERS_SQL}) " + " UNION ALL ".join(parts)


@query("cast_audit_strict", _audit_sql("strict"))
def q_cast_audit_strict(spark, d):
    return AU.cast_audit(M.dirty_orders(spark, d), M.DIRTY_FORMATS, mode="strict")


@query("cast_audit_roundtrip", _audit_sql("roundtrip"))
def q_cast_audit_roundtrip(spark, d):
    return AU.cast_audit(M.dirty_orders(spark, d), M.DIRTY_FORMATS, mode="roundtrip")


def _audit_summary_sql(n: int = 15) -> str:
    f = f"SELECT variable, line_number, coalesce(value, '') AS value FROM ({_audit_sql('roundtrip')})"
    return (f"WITH f AS ({f}), "
            f"l AS (SELECT variable, count(*) AS n_lines, "
            f"string_agg('''' || CAST(line_number AS VARCHAR) || '''', ', ' ORDER BY line_number) "
            f"FILTER (WHERE rn <= {n}) AS ll FROM (SELECT *, row_number() OVER (PARTITION BY variable "
            f"ORDER BY line_number) AS rn FROM f) GROUP BY variable), "
            f"pv AS (SELECT variable, value, min(line_number) AS first_line FROM f GROUP BY variable, value), "
            f"vv AS (SELECT variable, count(*) AS n_values, string_agg('''' || value || '''', ', ' "
            f"ORDER BY first_line) FILTER (WHERE rn <= {n}) AS vl FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY variable ORDER BY first_line) AS rn FROM pv) GROUP BY variable) "
            f"SELECT l.variable, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_values AS BIGINT) AS n_values, "
            f"ll || CASE WHEN n_lines > {n} THEN ', ...' ELSE '' END AS line_list, "
            f"vl || CASE WHEN n_values > {n} THEN ', ...' ELSE '' END AS value_list "
            f"FROM l JOIN vv USING (variable)")


@query("cast_audit_summary", _audit_summary_sql())
def q_cast_audit_summary(spark, d):
    return AU.audit_summary(AU.cast_audit(M.dirty_orders(spark, d), M.DIRTY_FORMATS, mode="roundtrip"))


# ============================================================ W1 line numbers
@query("line_numbers", "SELECT row_number() OVER (ORDER BY o_orderkey) AS line_number, o_orderkey FROM orders")
def q_line_numbers(spark, d):
    from tessera.operators.common import number_rows
    return number_rows(M.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


# ================================================ files


def _segment(col="_file"):
    return F.regexp_extract(F.col(col), r"/([a-z]+_[A-Za-z]+)/[^/]*$", 1)


def _intake_headers(spark, d, prefix="orders_"):
    root = IN.intake(spark, d)
    paths = [p for p in DL.list_files(spark, root) if f"/{prefix}" in p]
    return DL.file_headers(spark, paths)


@query("typed_scan",
       "SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS line_number, "
       "CAST(o_orderkey AS DECIMAL(38,0)) AS o_orderkey, CAST(o_custkey AS DECIMAL(38,0)) AS o_custkey, "
       "o_orderstatus, o_totalprice, o_orderdate, "
       "CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN NULL ELSE o_orderpriority END "
       "AS o_orderpriority FROM orders")
def q_typed_scan(spark, d):
    res = IG.load_entity(spark, _intake_headers(spark, d), M.ORDERS)
    return res.table.drop("file_line", "_file")


@query("segment_append",
       "SELECT 'orders_' || o_orderstatus AS segment, CAST(count(*) AS BIGINT) AS rows_loaded, "
       "CAST(min(o_orderkey) AS DECIMAL(38,0)) AS first_key FROM orders GROUP BY o_orderstatus")
def q_segment_append(spark, d):
    res = IG.load_entity(spark, _intake_headers(spark, d), M.ORDERS)
    return (res.table.groupBy(_segment().alias("segment"))
            .agg(F.count(F.lit(1)).alias("rows_loaded"), F.min("o_orderkey").alias("first_key")))


@query("header_match",
       "SELECT DISTINCT 'orders_' || o_orderstatus AS segment, 'orders' AS entity FROM orders "
       "UNION ALL SELECT 'orders_partial', NULL UNION ALL SELECT 'lineitem_all', 'lineitem' "
       "UNION ALL SELECT 'region_catalog', NULL "
       "UNION ALL SELECT DISTINCT 'documents_' || CASE WHEN lang = 'fr' THEN 'fr' ELSE 'other' END, NULL "
       "FROM documents")
def q_header_match(spark, d):
    root = IN.intake(spark, d)
    headers = DL.file_headers(spark, DL.list_files(spark, root))
    return DL.header_matches(headers, M.MODEL).select(_segment("file").alias("segment"), "entity").distinct()


SNIFF_TYPES = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "datetime", "o_orderpriority": "string"}


def _sniff_sql() -> str:
    parts = []
    for status, cols in IN.SEGMENT_ORDERS.items():
        for i, c in enumerate(cols):
            parts.append(f"SELECT DISTINCT 'orders_{status}' AS segment, '|' AS delimiter, {i} AS position, "
                         f"'{c}' AS name, '{SNIFF_TYPES[c]}' AS type FROM orders WHERE o_orderstatus = '{status}'")
    return " UNION ALL ".join(parts)


@query("file_sniff", _sniff_sql())
def q_file_sniff(spark, d):
    headers = _intake_headers(spark, d)
    out = None
    for g in DL.header_groups(headers, M.ORDERS):
        raw = DL.csv_rows(spark, [g], g.columns).withColumn("segment", _segment())
        s = DL.sniff(raw, g.columns, "segment")
        out = s if out is None else out.unionByName(s)
    seps = headers.select(_segment("file").alias("segment"), F.col("separator").alias("delimiter")).distinct()
    return out.join(seps, "segment").select("segment", "delimiter", "position", "name", "type")


@query("encoding_check",
       "SELECT DISTINCT 'documents_' || CASE WHEN lang = 'fr' THEN 'fr' ELSE 'other' END AS segment, "
       "CASE WHEN lang = 'fr' THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding FROM documents")
def q_encoding_check(spark, d):
    root = IN.intake(spark, d)
    paths = [p for p in DL.list_files(spark, root) if "/documents_" in p]
    per_file = FS.encoding_check(spark, paths)
    # a segment is readable as UTF-8 only when all its files are
    return (per_file.groupBy(_segment("file").alias("segment"))
            .agg(F.max(F.when(F.col("encoding") == FS.FALLBACK_ENCODING, 1).otherwise(0)).alias("_latin"))
            .select("segment", F.when(F.col("_latin") == 1, F.lit(FS.FALLBACK_ENCODING))
                    .otherwise(F.lit(FS.UTF8)).alias("encoding")))


@query("file_manifest")
def q_file_manifest(spark, d):
    root = IN.intake(spark, d)
    return FS.manifest(spark, root)


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q_content_sha256(spark, d):
    return M.table(spark, d, "documents").select("doc_id", TX.sha256_hex(F.col("text")).alias("sha256"))


@query("separator_inference",
       "SELECT doc_id, separator, CAST(len(lines) AS BIGINT) AS n_lines, "
       "CAST(len(list_filter(lines, lambda l: contains(l, separator))) AS BIGINT) AS n_lines_with_separator FROM "
       "(SELECT doc_id, string_split(text, chr(10)) AS lines, CASE WHEN length(s) > 0 THEN substr(s, 1, 1) ELSE '|' END "
       "AS separator FROM (SELECT doc_id, text, regexp_replace(rtrim(split_part(text, chr(10), 1)), "
       "'\"*[?a-zA-ZÀ-ÿñÑ0-9_-]*\"*', '', 'g') AS s FROM documents))")
def q_separator_inference(spark, d):
    """Separator of each document's header line, and over the whole text how
    many lines carry it (a delimited file's rows all should)."""
    docs = M.table(spark, d, "documents")
    sep = TX.infer_separator(TX.first_line(F.col("text")))
    lines = F.split(F.col("text"), "\n", -1)
    return (docs.select("doc_id", sep.alias("separator"), lines.alias("lines"))
            .select("doc_id", "separator", F.size("lines").cast("long").alias("n_lines"),
                    F.size(F.filter("lines", lambda x: x.contains(F.col("separator")))).cast("long")
                    .alias("n_lines_with_separator")))


@query("log_ansi_strip",
       "SELECT event_id, regexp_replace(line, chr(27) || '\\[[0-9;]*[mK]', '', 'g') AS line FROM "
       "(SELECT event_id, chr(27) || '[1;31m' || upper(event_type) || chr(27) || '[0m user=' || "
       "CAST(user_id AS VARCHAR) || chr(27) || '[K' AS line FROM events)")
def q_log_ansi_strip(spark, d):
    esc = F.lit("\x1b")
    ev = M.table(spark, d, "events")
    line = F.concat(esc, F.lit("[1;31m"), F.upper("event_type"), esc, F.lit("[0m user="),
                    F.col("user_id").cast("string"), esc, F.lit("[K"))
    return ev.select("event_id", TX.strip_ansi(line).alias("line"))


# ============================================================ profiles

NUMERIC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMERIC_STATS = ["count", "missing", "min", "max", "mean", "std", "variance", "sum", "cv", "skewness", "kurtosis",
                 "zeros", "negatives", "infinite", "q05", "q25", "q50", "q75", "q95", "iqr", "range", "mad",
                 "n_distinct", "n_unique"]
_INT_STATS = {"count", "missing", "zeros", "negatives", "infinite", "n_distinct", "n_unique"}


def _r(col):
    return F.round(F.col(col), 6).alias(col)


# Statistics that depend on summation order are compared at 10 significant
# digits: the mantissa is rounded, then scaled back by an exact power of ten.
_SIG_STATS = {"mean", "std", "variance", "sum", "cv", "skewness", "kurtosis"}


def _sig(col, digits=10):
    x = F.col(col)
    p = F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x / p, digits) * p).alias(col)


def _sig_sql(expr, digits=10):
    return (f"CASE WHEN ({expr}) = 0 THEN ({expr}) ELSE round(({expr}) / pow(10.0, ceil(log10(abs({expr})))), "
            f"{digits}) * pow(10.0, ceil(log10(abs({expr})))) END")


def _numeric_sql() -> str:
    parts = []
    for c in NUMERIC_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS variable, CAST(count({x}) AS BIGINT) AS count, CAST(count_if({c} IS NULL) AS BIGINT) "
            f"AS missing, round(min({x}), 6) AS min, round(max({x}), 6) AS max, {_sig_sql(f'avg({x})')} AS mean, "
            f"{_sig_sql(f'stddev_samp({x})')} AS std, {_sig_sql(f'var_samp({x})')} AS variance, "
            f"{_sig_sql(f'sum({x})')} AS sum, "
            f"{_sig_sql(f'stddev_samp({x}) / nullif(avg({x}), 0)')} AS cv, {_sig_sql(f'skewness({x})')} AS skewness, "
            f"{_sig_sql(f'kurtosis({x})')} AS kurtosis, CAST(count_if({x} = 0) AS BIGINT) AS zeros, "
            f"CAST(count_if({x} < 0) AS BIGINT) AS negatives, CAST(count_if(isinf({x})) AS BIGINT) AS infinite, "
            + ", ".join(f"round(quantile_cont({x}, {q}), 6) AS q{int(round(q * 100)):02d}" for q in PR.QUANTILES)
            + f", round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 6) AS iqr, "
            f"round(max({x}) - min({x}), 6) AS range, round(mad({x}), 6) AS mad, "
            f"CAST(count(DISTINCT {x}) AS BIGINT) AS n_distinct, "
            f"CAST((SELECT count(*) FROM (SELECT {c} FROM v WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1))"
            f" AS BIGINT) AS n_unique FROM v")
    return f"WITH v AS ({M.LINEITEM_SQL}) " + " UNION ALL ".join(parts)


@query("profile_numeric", _numeric_sql())
def q_profile_numeric(spark, d):
    prof = PR.numeric_profile(M.lineitem_view(spark, d), NUMERIC_COLS, exact=True)
    return prof.select("variable", *[F.col(s) if s in _INT_STATS else _sig(s) if s in _SIG_STATS else _r(s)
                                     for s in NUMERIC_STATS])


CATEGORICAL_COLS = ["o_orderstatus", "o_orderpriority"]


def _categorical_sql() -> str:
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORICAL_COLS]
    return (f"WITH v AS ({M.ORDERS_SQL}), vc AS ({' UNION ALL '.join(parts)}), "
            f"t AS (SELECT variable, sum(n) AS total, max(n) AS freq FROM vc GROUP BY variable), "
            f"tv AS (SELECT vc.variable, min(value) AS top FROM vc JOIN t ON vc.variable = t.variable "
            f"AND vc.n = t.freq GROUP BY vc.variable) "
            f"SELECT vc.variable, value, CAST(n AS BIGINT) AS n, round(n / total, 6) AS share, "
            f"value = top AS is_top FROM vc JOIN t USING (variable) JOIN tv USING (variable)")


@query("profile_categorical", _categorical_sql())
def q_profile_categorical(spark, d):
    return PR.categorical_profile(M.orders_view(spark, d), CATEGORICAL_COLS).select(
        "variable", "value", "n", _r("share"), "is_top")


DATETIME_SQL_VIEW = "SELECT ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events"


@query("profile_datetime",
       f"WITH v AS ({DATETIME_SQL_VIEW}) " + " UNION ALL ".join(
           f"SELECT '{c}' AS variable, min({c}) AS min, max({c}) AS max, "
           f"round((epoch_us(max({c})) - epoch_us(min({c}))) / 1e6, 6) AS range_seconds, "
           f"CAST(count_if({c} IS NULL) AS BIGINT) AS missing, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct "
           f"FROM v" for c in ("ts", "day")))
def q_profile_datetime(spark, d):
    ev = M.table(spark, d, "events").select("ts", F.col("ts").cast("date").cast("timestamp_ntz").alias("day"))
    return PR.datetime_profile(ev, ["ts", "day"]).select("variable", "min", "max", _r("range_seconds"), "missing",
                                                         "n_distinct")


BOOL_SQL_VIEW = ("SELECT l_returnflag = 'R' AS is_returned, "
                 "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus = 'F' END AS is_final FROM lineitem")


@query("profile_boolean",
       f"WITH v AS ({BOOL_SQL_VIEW}) " + " UNION ALL ".join(
           f"SELECT '{c}' AS variable, CAST(count_if({c}) AS BIGINT) AS n_true, "
           f"CAST(count_if(NOT {c}) AS BIGINT) AS n_false, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM v"
           for c in ("is_returned", "is_final")))
def q_profile_boolean(spark, d):
    li = M.table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("is_returned"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_linestatus") == "F").alias("is_final"))
    return PR.boolean_profile(li, ["is_returned", "is_final"])


HIST_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


def _hist_sql(bins: int = PR.HISTOGRAM_BINS) -> str:
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM v WHERE {c} IS NOT NULL" for c in HIST_COLS]
    return (f"WITH v AS ({M.LINEITEM_SQL}), l AS ({' UNION ALL '.join(parts)}), "
            f"b AS (SELECT variable, min(x) AS lo, max(x) AS hi FROM l GROUP BY variable), "
            f"k AS (SELECT l.variable, lo, hi, CASE WHEN hi = lo THEN 1 ELSE "
            f"least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS BIGINT) + 1, {bins}) END AS bin "
            f"FROM l JOIN b USING (variable)) "
            f"SELECT variable, CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * (hi - lo) / {bins}, 6) AS lower, "
            f"round(lo + bin * (hi - lo) / {bins}, 6) AS upper, CAST(count(*) AS BIGINT) AS n "
            f"FROM k GROUP BY variable, bin, lo, hi")


@query("profile_histogram", _hist_sql())
def q_profile_histogram(spark, d):
    return PR.histogram(M.lineitem_view(spark, d), HIST_COLS).select("variable", "bin", _r("lower"), _r("upper"),
                                                                     "n")


def _overview_sql() -> str:
    parts = []
    for name, ent, view in (("lineitem", M.LINEITEM, M.LINEITEM_SQL), ("orders", M.ORDERS, M.ORDERS_SQL)):
        roles = PR.column_roles(ent)
        miss = " + ".join(f"count_if({c} IS NULL)" for c in ent.labels)
        n = len(ent.labels)
        parts.append(f"SELECT '{name}' AS entity, CAST(count(*) AS BIGINT) AS n_rows, {n} AS n_columns, "
                     f"CAST({miss} AS BIGINT) AS missing_cells, round(({miss}) / (count(*) * {n}), 6) AS missing_share, "
                     + ", ".join(f"{len(v)} AS n_{k}" for k, v in roles.items()) + f" FROM ({view})")
    return " UNION ALL ".join(parts)


@query("profile_overview", _overview_sql())
def q_profile_overview(spark, d):
    a = PR.overview(M.lineitem_view(spark, d), M.LINEITEM)
    b = PR.overview(M.orders_view(spark, d), M.ORDERS)
    return a.unionByName(b).withColumn("missing_share", F.round("missing_share", 6))


@query("profile_monotonic",
       f"WITH v AS ({M.LINEITEM_LINES_SQL}), l AS (" + " UNION ALL ".join(
           f"SELECT '{c}' AS variable, line_number, CAST({c} AS DOUBLE) AS x FROM v WHERE {c} IS NOT NULL"
           for c in ("l_orderkey", "l_quantity")) +
       "), d AS (SELECT variable, x - lag(x) OVER (PARTITION BY variable ORDER BY line_number) AS d FROM l) "
       "SELECT variable, count_if(d < 0) = 0 AS increasing, count_if(d > 0) = 0 AS decreasing FROM d "
       "GROUP BY variable")
def q_profile_monotonic(spark, d):
    return PR.monotonic(M.lineitem_lines(spark, d), ["l_orderkey", "l_quantity"])


# ===================================================== status and reports (R, J6, A6, U1, L4, L6)


def _load_status(spark, d):
    load, _ = IN.staged_load(spark, d)
    return ST.entity_status(load.select("entity", "matched_files", "rows_read"))


# what the intake holds for the driver model: orders and lineitem files only
LOAD_STATUS_SQL = ("SELECT 'orders' AS entity, 'success' AS status, CAST(count(*) AS BIGINT) AS total_records "
                   "FROM orders UNION ALL SELECT 'lineitem', 'success', CAST(count(*) AS BIGINT) FROM lineitem "
                   "UNION ALL SELECT 'events', 'missing', CAST(0 AS BIGINT) UNION ALL "
                   "SELECT 'nation', 'missing', CAST(0 AS BIGINT) UNION ALL SELECT 'customer', 'missing', "
                   "CAST(0 AS BIGINT)")


@query("entity_status", LOAD_STATUS_SQL)
def q_entity_status(spark, d):
    return _load_status(spark, d)


@query("load_summary",
       "SELECT CAST(2 AS BIGINT) AS entities_loaded, "
       "'Total number of entities that have been matched to an uploaded file: 2' AS message "
       "FROM (SELECT count(*) AS n FROM orders) WHERE n > 0")
def q_load_summary(spark, d):
    return ST.load_summary(_load_status(spark, d))


_VALIDATION_OUTPUT: dict = {}


def _records(spark, d):
    """The validation output of the run, as the status step reads it: the
    records are written once per session and table folder (one row per
    entity) and read back by every status, badge and threshold query."""
    key = (IN.ensure_checkpoint_dir(spark), d)
    if key not in _VALIDATION_OUTPUT:
        path = _scratch(spark, "validator-output")
        validation_records(spark, d).write.parquet(path)
        _VALIDATION_OUTPUT[key] = path
    return spark.read.parquet(_VALIDATION_OUTPUT[key])


def _validator_metrics_sql() -> str:
    """Per validated entity: rows, rule fails, catalog fails, NULL cells."""
    parts = []
    for name, ent, _, view, var, codes in CATALOG_ENTITIES:
        rules = [r.expression for r in ent.rules]
        rule_fail = " + ".join(f"count_if({_not_passing(r)})" for r in rules) or "0"
        nulls = " + ".join(f"count_if({c} IS NULL)" for c in ent.labels)
        cat = (f"(SELECT count(*) FROM ({view}) v LEFT JOIN ({codes}) c ON v.{var} = c.code "
               f"WHERE c.code IS NULL AND v.{var} IS NOT NULL)")
        parts.append(f"SELECT '{name}' AS entity, CAST(count(*) AS BIGINT) AS total_registries, "
                     f"CAST({rule_fail} AS BIGINT) AS rule_fails, CAST({cat} AS BIGINT) AS catalog_fails, "
                     f"CAST({nulls} AS BIGINT) AS na_count FROM ({view})")
    return " UNION ALL ".join(parts)


@query("entity_quality_rollup",
       f"WITH l AS ({LOAD_STATUS_SQL}), m AS ({_validator_metrics_sql()}) "
       "SELECT entity, coalesce(l.status, 'success') AS status, "
       "CAST(coalesce(m.total_registries, l.total_records, 0) AS BIGINT) AS total_records, "
       "CAST(coalesce(rule_fails, 0) AS BIGINT) AS rule_fails, CAST(coalesce(catalog_fails, 0) AS BIGINT) "
       "AS catalog_fails, CAST(coalesce(na_count, 0) AS BIGINT) AS na_count, "
       "CASE WHEN l.status = 'fatal' THEN 'fatal' WHEN l.status = 'missing' THEN 'missing' "
       "WHEN coalesce(rule_fails, 0) > 0 OR coalesce(catalog_fails, 0) > 0 OR coalesce(na_count, 0) > 0 "
       "THEN 'warning' ELSE 'ok' END AS badge FROM l FULL OUTER JOIN m USING (entity)")
def q_entity_quality_rollup(spark, d):
    return ST.quality_table(_load_status(spark, d), _records(spark, d))


def _check_rows_sql() -> str:
    parts = []
    for name, ent, _, view, var, codes in CATALOG_ENTITIES:
        for c in ent.labels:
            parts.append(f"SELECT '{name}' AS entity, 'null' AS kind, '{c}' AS \"check\", "
                         f"CAST(count_if({c} IS NULL) AS BIGINT) AS total_wrong_lines, "
                         f"CAST(count(*) AS BIGINT) AS total_registries FROM ({view})")
        for r in ent.rules:
            rq = r.expression.replace("'", "''")
            parts.append(f"SELECT '{name}', 'rule', '{rq}', CAST(count_if({_not_passing(r.expression)}) AS BIGINT), "
                         f"CAST(count(*) AS BIGINT) FROM ({view})")
        parts.append(f"SELECT '{name}', 'catalog', '{var}', CAST((SELECT count(*) FROM ({view}) v LEFT JOIN "
                     f"({codes}) c ON v.{var} = c.code WHERE c.code IS NULL AND v.{var} IS NOT NULL) AS BIGINT), "
                     f"CAST(count(*) AS BIGINT) FROM ({view})")
    return " UNION ALL ".join(parts)


@query("threshold_flags",
       f"SELECT entity, kind, \"check\", total_wrong_lines, CASE WHEN kind = 'null' THEN total_wrong_lines > 0 "
       f"ELSE total_wrong_lines > 0.2 * total_registries END AS flagged FROM ({_check_rows_sql()})")
def q_threshold_flags(spark, d):
    return ST.threshold_flags(ST.check_rows(_records(spark, d))).drop("total_registries")


@query("failing_checks",
       f"SELECT entity, kind, \"check\", total_wrong_lines FROM ({_check_rows_sql()}) WHERE total_wrong_lines > 0")
def q_failing_checks(spark, d):
    return ST.failing_checks(ST.check_rows(_records(spark, d))).drop("total_registries")


@query("quality_badge",
       f"SELECT entity, CASE WHEN l.status = 'fatal' THEN 'fatal' WHEN l.status = 'missing' THEN 'missing' "
       f"WHEN coalesce(rule_fails, 0) > 0 OR coalesce(catalog_fails, 0) > 0 OR coalesce(na_count, 0) > 0 "
       f"THEN 'warning' ELSE 'ok' END AS badge FROM ({LOAD_STATUS_SQL}) l FULL OUTER JOIN "
       f"({_validator_metrics_sql()}) m USING (entity)")
def q_quality_badge(spark, d):
    return ST.quality_table(_load_status(spark, d), _records(spark, d)).select("entity", "badge")


ENTITY_TABLES = ["orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events"]


@query("entity_counts",
       " UNION ALL ".join(f"SELECT '{t}' AS entity, {i} AS priority, CAST(count(*) AS BIGINT) AS n_registries "
                          f"FROM {t}" for i, t in enumerate(ENTITY_TABLES))
       + f" UNION ALL SELECT 'returns' AS entity, {ST.UNKNOWN_PRIORITY} AS priority, CAST(0 AS BIGINT)")
def q_entity_counts(spark, d):
    tables = {t: M.table(spark, d, t) for t in ENTITY_TABLES}
    tables["returns"] = None   # declared in the model, no table loaded
    return ST.entity_counts(spark, tables, ENTITY_TABLES).orderBy("priority", "entity")


@query("preview_first10", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview_first10(spark, d):
    # a top-k report: the limit is the feature (distributed take-ordered)
    return M.table(spark, d, "orders").orderBy("o_orderkey").limit(10)


def _log_lines(spark, root):
    raw = spark.read.text(root).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_file"),
                                       F.col("_metadata.file_block_start").alias("_block"))
    return file_line_numbers(raw).select(F.col("_file").alias("file"), F.col("file_line").alias("line"), "text")


def _site_status_sql() -> str:
    parts = []
    for e in IN.SITE_ENTITIES:
        if e == "supplier":
            parts.append(f"SELECT site, '{e}' AS entity, CASE WHEN {e} = 0 THEN 'missing' ELSE 'success' END AS "
                         f"status, CAST({e} AS BIGINT) AS total_records FROM s")
        else:
            parts.append(f"SELECT site, '{e}' AS entity, CASE WHEN {e} = 0 THEN 'fatal' ELSE 'success' END "
                         f"AS status, CAST({e} AS BIGINT) AS total_records FROM s")
    return f"WITH s AS ({IN.SITE_COUNTS_SQL}) " + " UNION ALL ".join(parts)


@query("log_load_results", _site_status_sql())
def q_log_load_results(spark, d):
    lines = _log_lines(spark, IN.site_logs(spark, d))
    res = LG.load_results(lines)
    return res.select(F.regexp_extract("file", r"site=(\d+)", 1).cast("int").alias("site"), "entity", "status",
                      "total_records")


@query("log_cast_errors",
       f"SELECT variable, 'orders_dirty.csv' AS filename, n_lines AS affected_rows, value_list AS examples "
       f"FROM ({_audit_summary_sql()})")
def q_log_cast_errors(spark, d):
    summary = AU.audit_summary(AU.cast_audit(M.dirty_orders(spark, d), M.DIRTY_FORMATS, mode="roundtrip"))
    lines = _log_lines(spark, IN.cast_error_log(spark, d, summary))
    return LG.cast_errors(lines).drop("file")


# ============================================================ V2 artifacts


def run_outputs(spark, d) -> str:
    """Write the outputs of one validation run over the driver tables:
    validation JSON, profiles, load logs and the orphan quarantine."""
    key = (IN.ensure_checkpoint_dir(spark), d + "#outputs")
    if key in IN._CACHE:
        return IN._CACHE[key]
    out = _scratch(spark, "outputs")
    RP.write_validation(RP.version_stamp(_records(spark, d), M.MODEL), f"{out}/dqa")
    RP.write_profiles(spark, M.MODEL, {"orders": M.orders_view(spark, d)}, f"{out}/dqa")
    spark.read.text(IN.site_logs(spark, d)).select("value").coalesce(1).write.text(f"{out}/logs/checking_data_syntax")
    orph = K.orphans(M.lineitem_view(spark, d), M.parent_orders(spark, d), LINEITEM_FK)
    orph.write.option("header", True).csv(f"{out}/errors_fk_lineitem")
    IN._CACHE[key] = out
    return out


@query("artifact_catalog")
def q_artifact_catalog(spark, d):
    return RP.artifact_catalog(spark, run_outputs(spark, d))


# ======================================== C4 orphan report (first 15 lines / values)
def _orphan_summary_sql(n: int = 15) -> str:
    f = (f"SELECT 'l_orderkey' AS variable, line_number, CAST(l_orderkey AS VARCHAR) AS value "
         f"FROM ({M.LINEITEM_LINES_SQL}) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM ({M.PARENT_SQL})) "
         f"AND l_orderkey IS NOT NULL")
    return (f"WITH f AS ({f}), "
            f"l AS (SELECT variable, count(*) AS n_lines, "
            f"string_agg('''' || CAST(line_number AS VARCHAR) || '''', ', ' ORDER BY line_number) "
            f"FILTER (WHERE rn <= {n}) AS ll FROM (SELECT *, row_number() OVER (PARTITION BY variable "
            f"ORDER BY line_number) AS rn FROM f) GROUP BY variable), "
            f"pv AS (SELECT variable, value, min(line_number) AS first_line FROM f GROUP BY variable, value), "
            f"vv AS (SELECT variable, count(*) AS n_values, string_agg('''' || value || '''', ', ' "
            f"ORDER BY first_line) FILTER (WHERE rn <= {n}) AS vl FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY variable ORDER BY first_line) AS rn FROM pv) GROUP BY variable) "
            f"SELECT l.variable, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_values AS BIGINT) AS n_values, "
            f"ll || CASE WHEN n_lines > {n} THEN ', ...' ELSE '' END AS line_list, "
            f"vl || CASE WHEN n_values > {n} THEN ', ...' ELSE '' END AS value_list "
            f"FROM l JOIN vv USING (variable)")


@query("fk_orphans_summary", _orphan_summary_sql())
def q_fk_orphans_summary(spark, d):
    """Orphan lines of the staged child, reported like a cast error: count,
    distinct keys, first 15 lines and keys."""
    orph = K.orphans(M.lineitem_lines(spark, d), M.parent_orders(spark, d), LINEITEM_FK)
    findings = orph.select(F.lit("l_orderkey").alias("variable"), "line_number",
                           F.col("l_orderkey").cast("string").alias("value"))
    return AU.audit_summary(findings)


# ================================= K5 nested record, flattened for the oracle
def _record_flat_sql(n: int = 10) -> str:
    parts = []
    for name, ent, _, view, var, codes in CATALOG_ENTITIES:
        for c in ent.labels:
            parts.append(f"SELECT '{name}' AS entity, 'null' AS kind, '{c}' AS name, "
                         f"CAST(count_if({c} IS NULL) AS BIGINT) AS total_wrong_lines, CAST(NULL AS BIGINT) AS "
                         f"passed_rule, '' AS wrong_lines, '' AS wrong_values FROM ({view})")
        rules = [r.expression for r in ent.rules]
        if rules:
            viol = _rule_violation_sql(view, rules)
            first = _first_lines_sql(viol, "rule_index", n)
            summ = _rule_summary_sql(view, rules)
            parts.append(f"SELECT '{name}', 'rule', s.expression, s.total_wrong_lines, s.passed_rule, "
                         f"coalesce(f.wrong_lines, ''), '' FROM ({summ}) s LEFT JOIN ({first}) f USING (rule_index)")
        cat = (f"SELECT v.line_number, CAST(v.{var} AS VARCHAR) AS value FROM ({view}) v LEFT JOIN ({codes}) c "
               f"ON v.{var} = c.code WHERE c.code IS NULL AND v.{var} IS NOT NULL")
        parts.append(
            f"SELECT '{name}', 'catalog', '{var}', CAST((SELECT count(*) FROM ({cat})) AS BIGINT), "
            f"CAST(NULL AS BIGINT), coalesce((SELECT string_agg(CAST(line_number AS VARCHAR), ', ' ORDER BY "
            f"line_number) || CASE WHEN (SELECT count(*) FROM ({cat})) > {n} THEN ', +' || CAST((SELECT count(*) "
            f"FROM ({cat})) - {n} AS VARCHAR) || ' lines' ELSE '' END FROM (SELECT line_number FROM ({cat}) "
            f"ORDER BY line_number LIMIT {n})), ''), "
            f"coalesce((SELECT string_agg(value, ', ' ORDER BY fl) || CASE WHEN (SELECT count(DISTINCT value) FROM "
            f"({cat})) > {n} THEN ', +' || CAST((SELECT count(DISTINCT value) FROM ({cat})) - {n} AS VARCHAR) || "
            f"' values' ELSE '' END FROM (SELECT value, min(line_number) AS fl FROM ({cat}) GROUP BY value "
            f"ORDER BY fl LIMIT {n})), '')")
    return " UNION ALL ".join(parts)


@query("validation_record_flat", _record_flat_sql())
def q_validation_record_flat(spark, d):
    """The nested validation records of four entities, one row per check."""
    rec = validation_records(spark, d)
    nulls = rec.select("entity", F.inline("na_count_list")).select(
        "entity", F.lit("null").alias("kind"), F.col("label").alias("name"),
        F.col("na_count").alias("total_wrong_lines"), F.lit(None).cast("long").alias("passed_rule"),
        F.lit("").alias("wrong_lines"), F.lit("").alias("wrong_values"))
    rules = rec.select("entity", F.inline("rules")).select(
        "entity", F.lit("rule").alias("kind"), F.col("expression").alias("name"), "total_wrong_lines",
        "passed_rule", joined("wrong_lines").alias("wrong_lines"), F.lit("").alias("wrong_values"))
    cats = rec.select("entity", F.inline("catalog_checking")).select(
        "entity", F.lit("catalog").alias("kind"), F.col("variable").alias("name"), "total_wrong_lines",
        F.lit(None).cast("long").alias("passed_rule"), joined("wrong_lines").alias("wrong_lines"),
        joined("wrong_values").alias("wrong_values"))
    return nulls.unionByName(rules).unionByName(cats)


def _categorical_summary_sql() -> str:
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORICAL_COLS]
    miss = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM v"
                              for c in CATEGORICAL_COLS)
    return (f"WITH v AS ({M.ORDERS_SQL}), vc AS ({' UNION ALL '.join(parts)}), "
            f"t AS (SELECT variable, count(*) AS n_distinct, max(n) AS freq FROM vc GROUP BY variable), "
            f"tv AS (SELECT vc.variable, min(value) AS top FROM vc JOIN t ON vc.variable = t.variable "
            f"AND vc.n = t.freq GROUP BY vc.variable), m AS ({miss}) "
            f"SELECT variable, CAST(n_distinct AS BIGINT) AS n_distinct, top, CAST(freq AS BIGINT) AS freq, missing "
            f"FROM t JOIN tv USING (variable) JOIN m USING (variable)")


@query("profile_categorical_summary", _categorical_summary_sql())
def q_profile_categorical_summary(spark, d):
    return PR.categorical_summary(M.orders_view(spark, d), CATEGORICAL_COLS)


@query("file_sniff_summary",
       "SELECT 'orders_' || o_orderstatus AS segment, '|' AS delimiter, "
       "CASE WHEN count_if(o_orderpriority = '4-NOT SPECIFIED') > 0 THEN '\"' ELSE '' END AS quote, "
       "'\\n' AS newline, true AS has_header, 6 AS n_columns, '%Y-%m-%d' AS date_format "
       "FROM orders GROUP BY o_orderstatus")
def q_file_sniff_summary(spark, d):
    """File properties of the order segments (quote, newline, header flag,
    column count, date layout), one text scan aggregated per file."""
    root = IN.intake(spark, d)
    paths = [p for p in DL.list_files(spark, root) if "/orders_" in p and "/orders_partial" not in p]
    per_file = DL.sniff_files(spark, paths)
    return (per_file.groupBy(_segment("file").alias("segment"))
            .agg(F.max("delimiter").alias("delimiter"), F.max("quote").alias("quote"),
                 F.max("newline").alias("newline"), F.bool_and("has_header").alias("has_header"),
                 F.max("n_columns").alias("n_columns"), F.max("date_format").alias("date_format")))


@query("catalog_file_scan",
       "SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS description FROM region")
def q_catalog_file_scan(spark, d):
    """A code list file read back with its separator and encoding inferred
    (S6): the region table written as ``code|description``."""
    root = IN.intake(spark, d)
    return DL.read_catalog(spark, f"{root}/region_catalog")


# ======================================== the two ends: what a load takes and a publish keeps
# Separator and defect of each segment, by o_orderkey modulo 5.
END_SEGMENTS = ((0, "|", None), (1, ";", None), (2, ",", "ragged row"), (3, "\t", "cell not castable"), (4, ";", None))


def ends_intake(spark, d) -> str:
    """Orders written as five segments with separators of their own; every row of
    segment 2 has a cell too many, every price of segment 3 is no number, and
    the priorities of segment 4 hold a line break inside quotes."""
    key = (IN.ensure_checkpoint_dir(spark), d + "#ends")
    if key in IN._CACHE:
        return IN._CACHE[key]
    root = _scratch(spark, "ends")
    text = IN.orders_text(spark, d)
    for k, sep, defect in END_SEGMENTS:
        seg = text.where(F.col("o_orderkey").cast("long") % 5 == k).orderBy(F.col("o_orderkey").cast("long"))
        if defect == "cell not castable":
            seg = seg.withColumn("o_totalprice", F.concat(F.lit("x"), "o_totalprice"))
        if k == 4:
            seg = seg.withColumn("o_orderpriority", F.concat(F.lit("line\n"), F.coalesce("o_orderpriority", F.lit(""))))
        path = f"{root}/ends_{'abcde'[k]}"
        if defect == "ragged row":
            cells = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in IN.ORDER_COLUMNS], F.lit("more"))
            # a header line per file, as the CSV writer does
            seg.select(cells.alias(sep.join(IN.ORDER_COLUMNS))).write.option("header", True).option(
                "quote", "").option("sep", "\x01").csv(path)
        else:
            seg.select(*IN.ORDER_COLUMNS).write.option("header", True).option("sep", sep).csv(path)
    IN._CACHE[key] = root
    return root


def _ends_load(spark, d):
    paths = DL.list_files(spark, ends_intake(spark, d))
    return IG.load_entity(spark, DL.file_headers(spark, paths), M.ORDERS)


_SEG_SQL = "'ends_' || substr('abcde', CAST(o_orderkey % 5 + 1 AS INTEGER), 1)"


@query("header_match_delimiters",
       f"SELECT DISTINCT {_SEG_SQL} AS segment, CASE o_orderkey % 5 WHEN 0 THEN '|' WHEN 2 THEN ',' WHEN 3 THEN chr(9) "
       "ELSE ';' END AS separator, 'orders' AS entity FROM orders")
def q_header_match_delimiters(spark, d):
    heads = DL.file_headers(spark, DL.list_files(spark, ends_intake(spark, d)))
    match = DL.header_matches(heads, M.MODEL).select("file", "entity")
    return (heads.join(match, "file").select(_segment("file").alias("segment"), "separator", "entity").distinct())


@query("load_outcome",
       f"SELECT {_SEG_SQL} AS segment, count(*) AS rows, CAST(CASE WHEN o_orderkey % 5 = 3 THEN count(*) ELSE 0 END AS BIGINT) "
       "AS bad_rows, CAST(CASE WHEN o_orderkey % 5 = 2 THEN count(*) ELSE 0 END AS BIGINT) AS ragged_rows, "
       "CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'refused' ELSE 'loaded' END AS status, "
       "CASE o_orderkey % 5 WHEN 2 THEN 'ragged row' WHEN 3 THEN 'cell not castable' END AS reason "
       "FROM orders GROUP BY o_orderkey % 5")
def q_load_outcome(spark, d):
    """Per segment what the load found and decided (one defect per segment)."""
    return (_ends_load(spark, d).files.groupBy(_segment("file").alias("segment"))
            .agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"), F.sum("ragged_rows").alias("ragged_rows"),
                 F.max("status").alias("status"), F.max("reason").alias("reason")))


@query("line_numbers_after_refusal",
       f"SELECT row_number() OVER (ORDER BY {_SEG_SQL}, o_orderkey) AS line_number, "
       "CAST(o_orderkey AS DECIMAL(38,0)) AS o_orderkey FROM orders WHERE o_orderkey % 5 NOT IN (2, 3)")
def q_line_numbers_after_refusal(spark, d):
    """Rows of the accepted files are numbered 1..n without gaps."""
    return _ends_load(spark, d).table.select("line_number", "o_orderkey")


@query("publish_outcome",
       "WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'), "
       "l AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS k FROM lineitem) "
       "SELECT 'orders' AS entity, count(*) AS staged, count(*) AS published, CAST(0 AS BIGINT) AS orphans, "
       "CAST(0 AS BIGINT) AS null_keys, count(*) AS rows FROM o UNION ALL "
       "SELECT 'lineitem', count(*), count(*) - count_if(k IS NOT NULL AND k NOT IN (SELECT o_orderkey FROM o)), "
       "count_if(k IS NOT NULL AND k NOT IN (SELECT o_orderkey FROM o)), count_if(k IS NULL), "
       "count(*) - count_if(k IS NOT NULL AND k NOT IN (SELECT o_orderkey FROM o)) FROM l")
def q_publish_outcome(spark, d):
    """A publish of orders without the pending ones and of all line items, the
    seventh lines without an order: rows in, published, put aside, without a parent's name."""
    from tessera.operators.publish import publish
    orders = M.orders_view(spark, d).where("o_orderstatus <> 'P'")
    items = M.lineitem_view(spark, d).withColumn("l_orderkey", F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")))
    rep = publish(spark, M.MODEL, {"orders": orders, "lineitem": items}, _scratch(spark, "target"),
                  _scratch(spark, "quarantine"), append=["lineitem"])
    columns = ("staged", "published", "orphans", "null_keys", "rows")
    return spark.createDataFrame([(e, *[r[c] for c in columns]) for e, r in rep.items()],
                                 "entity string, " + ", ".join(f"{c} long" for c in columns))


@query("profile_large_integer",
       "WITH v AS (SELECT 9007199254740992 + l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) "
       "SELECT 'k' AS variable, count(*) AS n_distinct, count_if(n = 1) AS n_unique FROM v")
def q_profile_large_integer(spark, d):
    """Distinct and unique counts of integers that doubles cannot tell apart."""
    df = M.table(spark, d, "lineitem").select((F.lit(9007199254740992) + F.col("l_orderkey")).cast("decimal(38,0)").alias("k"))
    return PR.numeric_profile(df, ["k"]).select("variable", "n_distinct", "n_unique")


@query("profile_text",
       " UNION ALL ".join(f"SELECT '{c}' AS variable, count_if({c} IS NULL) AS missing, count_if({c} = '') AS empty, "
                          f"CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, "
                          f"round(avg(length({c})), 6) AS mean_length FROM documents" for c in ("text", "lang", "source")))
def q_profile_text(spark, d):
    out = PR.text_profile(M.table(spark, d, "documents"), ["text", "lang", "source"])
    return out.drop("n_distinct").withColumn("mean_length", F.round("mean_length", 6))


@query("profile_histogram_infinite",
       "WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS x FROM lineitem WHERE l_linenumber > 1), "
       "b AS (SELECT min(x) AS lo, max(x) AS hi FROM v) "
       "SELECT 'x' AS variable, CAST(least(floor((x - lo) / (hi - lo) * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n "
       "FROM v, b GROUP BY 2")
def q_profile_histogram_infinite(spark, d):
    """The histogram of quantities whose first lines are infinite: only finite values are binned."""
    x = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("l_quantity").cast("double"))
    return PR.histogram(M.table(spark, d, "lineitem").select(x.alias("x")), ["x"]).select("variable", "bin", "n")


# ======================================== names, stamps and corrected status
_NAME_SQL = ("source || '_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 6 WHEN 0 THEN '.html' WHEN 1 THEN '.LOG' WHEN 2 THEN '.txt' "
             "WHEN 3 THEN '.tar.py' WHEN 4 THEN '.R' ELSE '_Validator.json' END")
_PATH_SQL = "CASE doc_id % 4 WHEN 0 THEN 'logs/' WHEN 1 THEN 'out/dqa run/' WHEN 2 THEN 'my scripts/' ELSE '' END"


@query("artifact_names",
       f"WITH n AS (SELECT doc_id, {_NAME_SQL} AS name, {_PATH_SQL} || {_NAME_SQL} AS path FROM documents) "
       "SELECT doc_id, CASE WHEN path LIKE '%logs%' THEN 'logs' WHEN path LIKE '%dqa%' OR lower(name) LIKE '%validator%' "
       "THEN 'dqa' WHEN lower(name) LIKE '%.log' OR lower(name) LIKE '%.txt' THEN 'logs' ELSE 'analysis' END AS category, "
       "lower(split_part(name, '.', 2)) IN ('py', 'r', 'qmd') AS is_script, replace(path, ' ', '_') AS safe_path, "
       "row_number() OVER (PARTITION BY lower(split_part(name, '.', 2)) IN ('py', 'r', 'qmd') ORDER BY path) AS place FROM n")
def q_artifact_names(spark, d):
    """Class, script flag, safe path and place in the name order of names rendered from documents."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".html", ".LOG", ".txt", ".tar.py", ".R", "_Validator.json")]),
                       (F.col("doc_id") % 6 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("logs/", "out/dqa run/", "my scripts/", "")]),
                          (F.col("doc_id") % 4 + 1).cast("int"))
    n = M.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ext)
                                              .alias("name"), folder.alias("folder"))
    n = n.withColumn("path", F.concat("folder", "name")).withColumn("is_script", TX.is_script(F.col("name")))
    from tessera.operators.common import number_rows
    numbered = number_rows(n, ["is_script", "path"], "_line")    # the two groups follow one another
    starts = numbered.groupBy("is_script").agg(F.min("_line").alias("_first"))
    return (numbered.join(F.broadcast(starts), "is_script")
            .select("doc_id", TX.artifact_category(F.col("path"), F.col("name")).alias("category"), "is_script",
                    TX.underscore_spaces(F.col("path")).alias("safe_path"), (F.col("_line") - F.col("_first") + 1).alias("place")))


@query("minute_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp FROM events")
def q_minute_stamps(spark, d):
    return M.table(spark, d, "events").select("event_id", TX.minute_stamp(F.col("ts")).alias("stamp"))


@query("status_correction",
       "SELECT 'orders' AS entity, CASE WHEN count(*) > 0 THEN 'success' ELSE 'fatal' END AS status, count(*) AS total_records "
       "FROM orders UNION ALL SELECT 'lineitem', 'success', count(*) FROM lineitem "
       "UNION ALL SELECT 'customer', 'missing', 0 FROM (SELECT count(*) FROM customer) "
       "UNION ALL SELECT 'nation', 'fatal', count(*) FROM nation WHERE n_nationkey IS NULL")
def q_status_correction(spark, d):
    """A load that read 0 orders is corrected by the table's own count; one whose table is empty stays fatal."""
    count = lambda df, e: df.agg(F.lit(e).alias("entity"), F.count(F.lit(1)).alias("n"))
    items = M.table(spark, d, "lineitem").agg(F.lit("lineitem").alias("entity"), F.lit(1).cast("long").alias("matched_files"),
                                              F.count(F.lit(1)).alias("rows_read"))
    load = items.unionByName(spark.createDataFrame(
        [("orders", 1, 0), ("customer", 0, 0), ("nation", 1, 0)], "entity string, matched_files long, rows_read long"))
    counts = count(M.table(spark, d, "orders"), "orders").unionByName(
        count(M.table(spark, d, "nation").where("n_nationkey IS NULL"), "nation")).unionByName(
        count(M.table(spark, d, "customer"), "customer"))
    return ST.correct_status(ST.entity_status(load), counts)
