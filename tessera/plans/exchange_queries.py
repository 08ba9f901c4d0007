"""Registered queries over what comes in as files and goes out to a target, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import logs as LG
from tessera.operators import publish as P
from tessera.operators import sketches as SK
from tessera.operators import status as ST
from tessera.operators.common import file_line_numbers, number_rows
from tessera.plans import driver_model as M
from tessera.plans import intake as IN
from tessera.plans import report as RP
from tessera.plans.queries import ENTITY_TABLES, ORACLE, query
from tessera.session import scratch_path, write_read
from tessera.sources import delimited as DL
from tessera.sources import dialect as DI
from tessera.sources import encodings as EN
from tessera.sources import files as FS
from tessera.sources import target_source as TS


# ============================================================ S3 dialect search
def _sql_text(s: str) -> str:
    return "chr(9)" if s == "\t" else "'" + s.replace("'", "''") + "'"


def _dialect_sql() -> str:
    files = f"count(DISTINCT o_orderkey // {IN.DIALECT_KEYS})"
    parts = []
    for name, (sep, cell, before) in IN.DIALECTS.items():
        quote = "" if cell == "{}" else cell[0]
        escape = "\\" if "\\" in cell else '"' if '""' in cell else ""
        written = 1 + len([b for b in before if b])
        parts.append(
            f"SELECT '{name}' AS segment, {_sql_text(sep)} AS delimiter, {_sql_text(quote)} AS quote, {_sql_text(escape)} AS escape, "
            f"'\\n' AS newline, CAST({len(before)} AS BIGINT) AS skipped_rows, true AS has_header, 4 AS n_columns, "
            f"'o_orderkey,o_orderdate,o_orderstatus,o_orderpriority' AS header, '%Y-%m-%d' AS date_format, "
            f"'%Y-%m-%d %H:%M:%S' AS timestamp_format, {files} AS files, count(*) + {written} * {files} AS lines, "
            f"count(*) + {files} AS consistent_lines FROM orders HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


@query("sniff_dialect", _dialect_sql())
def q_sniff_dialect(spark, d):
    """Dialect, preamble and layouts found in files of five dialects, from one aggregate over all their lines."""
    root = IN.dialect_intake(spark, d)
    found = DI.sniff_dialect(spark, DL.list_files(spark, root, "*.txt"))
    segment = F.regexp_extract("file", "segment=([a-z]+)/", 1).alias("segment")
    same = ["delimiter", "quote", "escape", "newline", "skipped_rows", "has_header", "n_columns",
            F.array_join("header", ",").alias("header"), "date_format", "timestamp_format"]
    return found.groupBy(segment, *same).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"),
                                             F.sum("consistent_lines").alias("consistent_lines"))


# ============================================================ K9 / K3 commits and parts
TARGET_PARTS = 64


@query("publish_two_runs",
       "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE round(o_totalprice * 2, 2) END AS o_totalprice, "
       "o_orderstatus FROM orders")
def q_publish_two_runs(spark, d):
    """The target after two runs that overlapped: the first publishes final and open orders, the second, which
    commits while the first is about to, all that are not final at twice the price; the first takes them in.
    Open orders are then as the first run has them, which is later."""
    orders = M.orders_view(spark, d)
    double = orders.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    target = scratch_path(spark, "target")

    def second(attempt):
        if attempt == 0:
            P.publish(spark, M.MODEL, {"orders": double.where("o_orderstatus <> 'F'")}, target, parts=TARGET_PARTS)

    first = orders.where("o_orderstatus = 'F'").unionByName(double.where("o_orderstatus = 'O'"))
    P.publish(spark, M.MODEL, {"orders": first}, target, parts=TARGET_PARTS, before_commit=second)
    return P.read_target(spark, target, M.ORDERS).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice",
                                                         "o_orderstatus")


_PART_SQL = f"CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % {TARGET_PARTS} AS INTEGER)"


@query("upsert_parts_rewritten",
       f"WITH dear AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20), "
       f"t AS (SELECT {_PART_SQL} AS part, count(*) AS rows FROM orders GROUP BY 1), "
       f"s AS (SELECT {_PART_SQL} AS part, count(*) AS source_rows FROM dear GROUP BY 1) "
       "SELECT t.part, t.rows, s.source_rows FROM t JOIN s USING (part)")
def q_upsert_parts_rewritten(spark, d):
    """The parts of a target of all orders that a correction of the twenty dearest rewrites, with their rows."""
    orders = M.orders_view(spark, d)
    target = scratch_path(spark, "target")
    P.publish(spark, M.MODEL, {"orders": orders}, target, parts=TARGET_PARTS)
    before = P.last_commit(spark, target).tables["orders"]
    dear = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)     # a top-k report
    P.publish(spark, M.MODEL, {"orders": dear.withColumn("o_orderpriority", F.lit("1-URGENT"))}, target)
    after = P.last_commit(spark, target).tables["orders"]
    made = [(int(k), p.rows) for k, p in after.parts.items() if before.parts.get(k) != p]    # one row a part
    met = dear.groupBy(P.part_number(["o_orderkey"], TARGET_PARTS).alias("part")).agg(F.count(F.lit(1)).alias("source_rows"))
    return spark.createDataFrame(made, "part int, rows long").join(F.broadcast(met), "part", "left")


# ============================================================ R6 one log of all sites
def _all_sites_log(spark, d) -> str:
    """The logs of all sites one after another in one log, each entity's lines under the site's name."""
    key = (IN.ensure_checkpoint_dir(spark), d + "#onelog")
    if key not in IN._CACHE:
        site = F.regexp_extract(F.col("_metadata.file_path"), r"site=(\d+)", 1)
        lines = spark.read.text(IN.site_logs(spark, d)).select(
            site.cast("int").alias("site"), F.regexp_replace("value", r'"([\w ]+)"', F.concat(F.lit('"$1 '), site, F.lit('"'))).alias("text"),
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        IN._CACHE[key] = scratch_path(spark, "onelog")
        numbered = file_line_numbers(lines)      # sites in the order of their files' names
        numbered.select("line_number", "text").write.parquet(IN._CACHE[key])
    return IN._CACHE[key]


@query("log_of_all_sites", "SELECT CAST(site AS INTEGER) AS site, entity, status, total_records FROM (" + ORACLE["log_load_results"] + ")")
def q_log_of_all_sites(spark, d):
    """Load results read from one log that holds the lines of all sites, in chunks of 16 lines."""
    lines = spark.read.parquet(_all_sites_log(spark, d)).select(F.lit("all").alias("file"), F.col("line_number").alias("line"), "text")
    found = LG.load_results(lines, 16)
    return found.select(F.split_part("entity", F.lit(" "), F.lit(2)).cast("int").alias("site"),
                        F.split_part("entity", F.lit(" "), F.lit(1)).alias("entity"), "status", "total_records")


# ============================================================ A8 / A10 profiles merged from segments
SKETCHED = ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
SKETCHED_TIMES = ("l_shipdate",)


def _incremental_sql() -> str:
    bounded = "true AS quantiles_within, true AS distinct_within"
    parts = [f"SELECT '{c}' AS variable, CAST(3 AS BIGINT) AS segments, count(*) AS rows, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, "
             f"CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
             f"CAST(count_if({c} = 0) AS BIGINT) AS zeros, {bounded} FROM t" for c in SKETCHED]
    parts += [f"SELECT '{c}', 3, count(*), count({c}), epoch_us(min({c})::TIMESTAMP)::DOUBLE, epoch_us(max({c})::TIMESTAMP)::DOUBLE, "
              f"NULL, NULL, 0, {bounded} FROM t" for c in SKETCHED_TIMES]
    return ("WITH t AS (SELECT * REPLACE (nullif(l_discount, 0.05) AS l_discount) FROM lineitem) " + " UNION ALL ".join(parts))


@query("profile_incremental", _incremental_sql())
def q_profile_incremental(spark, d):
    """The profile of all line items merged from the sketches of three segments (by return flag), one appended after
    another and the first twice; quantiles and distinct counts are held against exact ranks and counts."""
    items = M.table(spark, d, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0.05)"))
    root = scratch_path(spark, "sketches")
    for flag in ("A", "N", "R", "A"):
        SK.append_segment(items.where(F.col("l_returnflag") == flag), root, flag, SKETCHED, SKETCHED_TIMES)
    got = write_read(SK.merged_profile(spark, root), "profile")
    # the exact rank range of each estimate, one aggregate for all columns
    asked = {r["variable"]: r["quantiles"] for r in got.collect()}        # one row a column
    value = {**{c: F.col(c).cast("double") for c in SKETCHED},
             **{c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") for c in SKETCHED_TIMES}}
    checks = []
    for c, x in value.items():
        n, ok = F.count(x), F.lit(True)
        for p, q in zip(SK.QUANTILES, asked[c] or []):
            ok = ok & (F.count_if(x < q) / n <= p + SK.RANK_ERROR) & (F.count_if(x <= q) / n >= p - SK.RANK_ERROR)
        checks.append(F.struct(F.lit(c).alias("variable"), ok.alias("quantiles_within"), F.count_distinct(F.col(c)).alias("_exact")))
    exact = items.agg(F.array(*checks).alias("_c")).select(F.inline("_c"))
    near = F.abs(F.col("n_distinct") - F.col("_exact")) <= F.greatest(F.lit(1.0), F.col("_exact") * SK.DISTINCT_ERROR)
    number = ~F.col("is_time")
    return got.join(F.broadcast(exact), "variable").select(
        "variable", "segments", "rows", "n", "min", "max", F.when(number, F.round("mean", 4)).alias("mean"),
        F.when(number, F.round("std", 4)).alias("std"), "zeros", "quantiles_within", near.alias("distinct_within"))


# ============================================================ V1 / S11 manifests that read what changed
def _order_files(spark, d, statuses, root) -> None:
    """Orders of these statuses as text, one file for ``IN.DIALECT_KEYS`` order keys."""
    o = M.table(spark, d, "orders").where(F.col("o_orderstatus").isin(*statuses))
    rows = o.select("o_orderstatus", F.floor(F.col("o_orderkey") / IN.DIALECT_KEYS).alias("part"), "o_orderkey",
                    F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("text"))
    (rows.repartition("o_orderstatus", "part").sortWithinPartitions("o_orderstatus", "part", "o_orderkey")
     .select("o_orderstatus", "part", "text").write.mode("append").partitionBy("o_orderstatus", "part").text(root))


@query("manifest_delta",
       "SELECT o_orderstatus AS segment, o_orderkey // " + str(IN.DIALECT_KEYS) + " AS part, "
       "sha256(string_agg(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority, chr(10) ORDER BY o_orderkey) || chr(10)) AS sha256, "
       "CAST(sum(length(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority) + 1) AS BIGINT) AS size, "
       "CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'same' END AS status FROM orders GROUP BY ALL")
def q_manifest_delta(spark, d):
    """The second manifest of a folder: final and open orders are there from the first, pending ones are new."""
    root = scratch_path(spark, "provenance")
    _order_files(spark, d, ("F", "O"), root)
    first = FS.manifest(spark, root)
    _order_files(spark, d, ("P",), root)
    second = FS.manifest(spark, root, previous=first).where(F.col("path").contains("part="))
    return second.select(F.regexp_extract("path", "o_orderstatus=([A-Z])/", 1).alias("segment"),
                         F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("part"), "sha256", "size", "status")


# ============================================================ S8 encodings
# Per language of documents the encoding that its files are written in, and a tail with signs of it.
WRITTEN_IN = {"en": (EN.UTF8, ""), "fr": (EN.LATIN1, ""), "de": (EN.CP1252, " „so“ – 5 €"), "es": (EN.UTF16LE, "")}


@query("encoding_scores",
       " UNION ALL ".join(f"SELECT '{lang}' AS lang, '{e}' AS encoding, true AS sure FROM documents WHERE lang = '{lang}' "
                          "HAVING count(*) > 0" for lang, (e, _) in WRITTEN_IN.items()))
def q_encoding_scores(spark, d):
    """Encoding found for the documents of each language, whole texts written in an encoding of its own."""
    root = scratch_path(spark, "encodings")
    docs = M.table(spark, d, "documents")
    for lang, (encoding, tail) in WRITTEN_IN.items():
        text = F.concat(F.regexp_replace("text", r"\r?\n", " "), F.lit(tail))
        if encoding == EN.CP1252:
            text = EN.as_cp1252(text)
        (docs.where(F.col("lang") == lang).select(text.alias("text")).write.option("sep", "\x01").option("quote", "")
         .option("encoding", EN.LATIN1 if encoding == EN.CP1252 else encoding).csv(f"{root}/lang={lang}"))
    found = EN.encoding_scores(spark, DL.list_files(spark, root))
    lang = F.regexp_extract("file", "lang=([a-z]+)/", 1).alias("lang")
    # a language's files agree, or none of them counts
    return (found.groupBy(lang).agg(F.collect_set("encoding").alias("_e"), F.min("confidence").alias("_c"))
            .select("lang", F.array_join("_e", ",").alias("encoding"), (F.col("_c") >= EN.CONFIDENCE).alias("sure")))


# ============================================================ S10 the target as a data source
@query("target_scan_pruned",
       "WITH dear AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) "
       "SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, "
       f"(SELECT count(DISTINCT CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % {TARGET_PARTS}) FROM dear) "
       "AS parts_read FROM orders o JOIN dear USING (o_orderkey)")
def q_target_scan_pruned(spark, d):
    """The five dearest orders read from a published target of all orders by their keys, and how many parts were read."""
    orders = M.orders_view(spark, d)
    target = scratch_path(spark, "target")
    P.publish(spark, M.MODEL, {"orders": orders}, target, parts=TARGET_PARTS)
    keys = [int(r["o_orderkey"]) for r in orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").limit(5).collect()]
    found = TS.read_target_source(spark, target, M.ORDERS).where(F.col("o_orderkey").isin(keys))
    return found.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
                        "o_orderstatus", "o_totalprice", F.lit(found.rdd.getNumPartitions()).cast("long").alias("parts_read"))


# ============================================================ U1, R5, O1 / V2, V3 on the given tables
@query("entity_counts_all_zero",
       " UNION ALL ".join(f"SELECT '{t}' AS entity, {i} AS priority, CAST(count(*) * 0 AS BIGINT) AS n_registries FROM {t}"
                          for i, t in enumerate(ENTITY_TABLES))
       + f" UNION ALL SELECT 'returns', {ST.UNKNOWN_PRIORITY}, CAST(0 AS BIGINT)")
def q_entity_counts_all_zero(spark, d):
    """Counts where one declared table is missing, as the reference has them: all are 0."""
    tables = {t: M.table(spark, d, t) for t in ENTITY_TABLES}
    return ST.entity_counts(spark, {**tables, "returns": None}, ENTITY_TABLES, compat_all_zero=True)


_STATUSES = ("customer", "orders", "lineitem")


@query("load_summary_cases",
       "WITH s AS (" + " UNION ALL ".join(f"SELECT count(*) AS n, count_if({k} IS NULL) AS none FROM {t}" for t, k in zip(
           _STATUSES, ("c_custkey", "o_orderkey", "l_orderkey"))) + "), c AS ("
       "SELECT 'all' AS loads, count_if(n > 0) AS entities_loaded FROM s UNION ALL SELECT 'none', count_if(none > 0) FROM s) "
       "SELECT loads, entities_loaded, CASE WHEN entities_loaded = 0 THEN 'None of the uploaded files have been matched with an entity!' "
       "ELSE 'Total number of entities that have been matched to an uploaded file: ' || entities_loaded END AS message FROM c")
def q_load_summary_cases(spark, d):
    """The outcome of a load of three tables, and of one that reads only their rows without a key: there are none."""
    out = None
    for case in ("all", "none"):
        load = None
        for t, k in zip(_STATUSES, ("c_custkey", "o_orderkey", "l_orderkey")):
            rows = M.table(spark, d, t).where(F.lit(case == "all") | F.col(k).isNull())
            one = rows.agg(F.lit(t).alias("entity"), F.lit(1).cast("long").alias("matched_files"), F.count(F.lit(1)).alias("rows_read"))
            load = one if load is None else load.unionByName(one)
        part = ST.load_summary(ST.entity_status(load)).select(F.lit(case).alias("loads"), "entities_loaded", "message")
        out = part if out is None else out.unionByName(part)
    return out


_ARTIFACT_SQL = ("source || '_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.log' ELSE '.HTML' END")


@query("artifact_order",
       f"WITH n AS (SELECT {_ARTIFACT_SQL} AS name, n_chars AS size, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(n_chars AS INTEGER)) "
       "AS mtime, 'out/' || lang AS folder FROM documents) "
       "SELECT row_number() OVER (ORDER BY lower(name) NOT LIKE '%.html', mtime DESC, name) AS place, name, "
       "CASE WHEN lower(name) LIKE '%.log' THEN 'logs' ELSE 'analysis' END AS category, size, strftime(mtime, '%Y-%m-%d %H:%M') AS date, "
       "coalesce(folder || '/', 'out/') || name AS path FROM n")
def q_artifact_order(spark, d):
    """Artifacts rendered from documents in the order of the catalog, html first, then newest first."""
    ext = F.element_at(F.array(F.lit(".html"), F.lit(".log"), F.lit(".HTML")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ext)
    stamp = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("n_chars").cast("long") * 60_000_000)
    path = F.concat(F.lit("out/"), F.coalesce(F.concat("lang", F.lit("/")), F.lit("")), name)
    files = M.table(spark, d, "documents").select(name.alias("name"), path.alias("rel_path"), F.col("n_chars").alias("size"), stamp.alias("mtime"))
    placed = number_rows(RP.artifact_rows(files), [*RP.artifact_order(), "name"], "place")
    return placed.select("place", "name", "category", "size", "date", "path")


@query("version_stamps",
       f"SELECT o_orderstatus, count(*) AS n, '{M.MODEL.version}' AS model_version, '{RP.ENGINE_VERSION}' AS engine_version, "
       "'run-7' AS pipeline_version FROM orders GROUP BY 1")
def q_version_stamps(spark, d):
    """A result table with the versions of the model, the engine and the pipeline on every row."""
    counts = M.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return RP.version_stamp(counts, M.MODEL, "run-7")
