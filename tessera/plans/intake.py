"""Driver tables written out as an intake folder of delimited files.

The load, sniff, header-match, encoding and manifest operators work on real
files, so the registered queries first let Spark write the driver tables as
CSV segments into the session's shared checkpoint folder (never a
machine-local one), then read them back through the library.  Everything is
derived from whole tables; a folder is written once per table folder and
session and reused by the queries that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.casting import canonical_text
from tessera.plans import driver_model as M
from tessera.session import ensure_checkpoint_dir, scratch_path

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
# Each order status is one segment file set, each with its own
# column order (same column set).
SEGMENT_ORDERS = {
    "F": ORDER_COLUMNS,
    "O": list(reversed(ORDER_COLUMNS)),
    "P": ORDER_COLUMNS[2:] + ORDER_COLUMNS[:2],
}
# A file whose header lacks one declared column: it matches no entity.
PARTIAL_COLUMNS = [c for c in ORDER_COLUMNS if c != "o_custkey"]
LINEITEM_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# Language of documents written in a single-byte encoding.
LATIN1_LANGS = ("fr",)

_CACHE: dict[tuple[str, str], str] = {}


def orders_text(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Orders (or ``rows`` of them, kept in their order) as text cells: '5-LOW' written as the
    token NA, '4-NOT SPECIFIED' as an empty quoted cell."""
    o = M.table(spark, d, "orders") if rows is None else rows
    prio = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus", canonical_text(F.col("o_totalprice"), "double").alias("o_totalprice"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        F.when(prio == "5-LOW", F.lit("NA")).when(prio == "4-NOT SPECIFIED", F.lit("")).otherwise(prio)
         .alias("o_orderpriority"))


def _write(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    (df.write.mode("error").option("header", True).option("sep", "|").option("encoding", encoding)
     .csv(path))


def intake(spark: SparkSession, d: str) -> str:
    """Write (once) and return the intake folder for the tables in ``d``.

    The order segments are sorted by key, as their line numbers are reported; cells are
    rendered after the sort, so that it moves the stored values.  The other files hold
    their rows as the table has them: nothing reads an order from them."""
    key = (ensure_checkpoint_dir(spark), d)
    if key in _CACHE:
        return _CACHE[key]
    root = scratch_path(spark, "intake")
    orders = M.table(spark, d, "orders")
    for status, cols in SEGMENT_ORDERS.items():
        seg = orders.where(F.col("o_orderstatus") == status).orderBy("o_orderkey")
        _write(orders_text(spark, d, seg).select(*cols), f"{root}/orders_{status}")
    _write(orders_text(spark, d).select(*PARTIAL_COLUMNS), f"{root}/orders_partial")
    li = M.table(spark, d, "lineitem")
    _write(li.select([canonical_text(F.col(c), "double").alias(c) if c in
                      ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else F.col(c).cast("string").alias(c)
                      for c in LINEITEM_COLUMNS]), f"{root}/lineitem_all")
    region = M.table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("code"),
                                                F.col("r_name").alias("description"))
    _write(region, f"{root}/region_catalog")
    docs = M.table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    for lang in sorted(LATIN1_LANGS):
        _write(docs.where(F.col("lang") == lang), f"{root}/documents_{lang}", "ISO-8859-1")
    _write(docs.where(~F.col("lang").isin(*LATIN1_LANGS)), f"{root}/documents_other")
    _CACHE[key] = root
    return root


# -------------------------------------------------------------- dialects
# Per segment the delimiter, the quoted priority cell around the priority's text, and the lines before the header.
DIALECT_KEYS = 5000     # order keys of one file
DIALECTS = {
    "plain": (",", "{}", ()),
    "preamble": (";", "{}", ("Export of all orders, made by the site", "", "status: final | priority: as given")),
    "doubled": ("|", '"{} ""as told"" | kept"', ()),
    "backslash": (",", '"{} \\"as told\\", kept"', ("one line before the header",)),
    "single": ("\t", "'{}\tkept'", ()),
}


def dialect_intake(spark: SparkSession, d: str) -> str:
    """All orders once in every dialect, ``DIALECT_KEYS`` order keys to a file; each file
    begins with the lines of its dialect's preamble and a header."""
    key = (ensure_checkpoint_dir(spark), d + "#dialects")
    if key in _CACHE:
        return _CACHE[key]
    root = scratch_path(spark, "dialects")
    orders = M.table(spark, d, "orders")
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    out = None
    for name, (sep, cell, before) in DIALECTS.items():
        lead, tail = cell.split("{}")
        value = F.concat_ws(sep, F.col("o_orderkey").cast("string"), stamp, "o_orderstatus",
                            F.concat(F.lit(lead), F.col("o_orderpriority"), F.lit(tail)))
        rows = orders.select(F.lit(name).alias("segment"), F.floor(F.col("o_orderkey") / DIALECT_KEYS).alias("part"),
                             F.col("o_orderkey").cast("long").alias("seq"), value.alias("text"))
        heads = [*before, sep.join(("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"))]
        first = F.array(*[F.struct(F.lit(i - 1000).cast("long").alias("seq"), F.lit(t).alias("text")) for i, t in enumerate(heads)])
        part = rows.unionByName(rows.select("segment", "part").distinct().select("segment", "part", F.inline(first)))
        out = part if out is None else out.unionByName(part)
    (out.repartition("segment", "part").sortWithinPartitions("segment", "part", "seq").select("segment", "part", "text")
     .write.partitionBy("segment", "part").text(root))
    _CACHE[key] = root
    return root


# ------------------------------------------------------------------ logs
# Log line texts as the load step writes them.
LOG_MISSING = ('WARNING:: No file of the uploaded files has been found that matches the header with the '
               'configuration of the "{}" entity.!')
LOG_TABLE = 'INFO:: Trying to load records in the table "{}"'
SITE_ENTITIES = ["customer", "supplier", "orders", "lineitem"]


def site_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per nation (a site): rows each entity would load there."""
    nation = M.table(spark, d, "nation").select(F.col("n_nationkey").alias("site"))
    cust = M.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("site"))
    supp = M.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg(F.count(F.lit(1)).alias("supplier"))
    orders = M.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    o_site = orders.join(cust, "c_custkey")
    n_orders = o_site.groupBy("site").agg(F.count(F.lit(1)).alias("orders"))
    li = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    n_li = li.join(o_site.select("o_orderkey", "site"), "o_orderkey").groupBy("site").agg(F.count(F.lit(1)).alias("lineitem"))
    n_cust = cust.groupBy("site").agg(F.count(F.lit(1)).alias("customer"))
    out = nation
    for part in (n_cust, supp, n_orders, n_li):
        out = out.join(part, "site", "left")
    return out.fillna(0)


SITE_COUNTS_SQL = (
    "SELECT n.n_nationkey AS site, coalesce(c.n, 0) AS customer, coalesce(s.n, 0) AS supplier, "
    "coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS lineitem FROM nation n "
    "LEFT JOIN (SELECT c_nationkey AS site, count(*) AS n FROM customer GROUP BY 1) c ON c.site = n.n_nationkey "
    "LEFT JOIN (SELECT s_nationkey AS site, count(*) AS n FROM supplier GROUP BY 1) s ON s.site = n.n_nationkey "
    "LEFT JOIN (SELECT c_nationkey AS site, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey "
    "GROUP BY 1) o ON o.site = n.n_nationkey "
    "LEFT JOIN (SELECT c_nationkey AS site, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey GROUP BY 1) l ON l.site = n.n_nationkey")


def site_logs(spark: SparkSession, d: str) -> str:
    """Write one load log per site (``site=<n>/part-*.txt``); a supplier
    count of 0 is logged as a missing file."""
    key = (ensure_checkpoint_dir(spark), d + "#logs")
    if key in _CACHE:
        return _CACHE[key]
    root = scratch_path(spark, "logs")
    counts = site_counts(spark, d)
    items = []
    for i, e in enumerate(SITE_ENTITIES):
        n = F.col(e)
        missing = F.array(F.struct(F.lit(i * 10).alias("seq"), F.lit(LOG_MISSING.format(e)).alias("text")))
        loaded = F.array(
            F.struct(F.lit(i * 10).alias("seq"), F.lit(LOG_TABLE.format(e)).alias("text")),
            F.struct(F.lit(i * 10 + 1).alias("seq"),
                     F.concat(F.lit("INFO:: "), n.cast("string"), F.lit(" records read.")).alias("text")))
        items.append(F.when((F.lit(e) == "supplier") & (n == 0), missing).otherwise(loaded))
    lines = counts.select("site", F.inline(F.flatten(F.array(*items))))
    (lines.repartition("site").sortWithinPartitions("site", "seq").select("site", "text")
     .write.partitionBy("site").text(root))
    _CACHE[key] = root
    return root


def cast_error_log(spark: SparkSession, d: str, summary: DataFrame) -> str:
    """Write the cast-error log of a refused file from an audit summary
    ``(variable, n_lines, n_values, line_list, value_list)``."""
    key = (ensure_checkpoint_dir(spark), d + "#castlog")
    if key in _CACHE:
        return _CACHE[key]
    root = scratch_path(spark, "castlog")
    block = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("ERROR:: ---------").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.concat(F.lit("ERROR:: Checking variable: "), F.col("variable")).alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("ERROR:: Filename: orders_dirty.csv").alias("text")),
        F.struct(F.lit(3).alias("seq"), F.concat(F.lit("ERROR:: Found casting errors in "),
                                                 F.col("n_lines").cast("string"), F.lit(" line(s)")).alias("text")),
        F.struct(F.lit(4).alias("seq"), F.concat(F.lit("ERROR:: "), F.col("n_values").cast("string"),
                                                 F.lit(" values have been found that cause casting errors."))
                 .alias("text")),
        F.struct(F.lit(5).alias("seq"), F.concat(F.lit("ERROR:: Line number where errors were found: "),
                                                 F.col("line_list")).alias("text")),
        F.struct(F.lit(6).alias("seq"), F.concat(F.lit("ERROR:: Example of erroneous values found: "),
                                                 F.col("value_list")).alias("text")),
        F.struct(F.lit(7).alias("seq"), F.lit("ERROR:: ---------").alias("text")))
    lines = summary.select("variable", F.inline(block))
    lines.coalesce(1).sortWithinPartitions("variable", "seq").select("text").write.text(root)
    _CACHE[key] = root
    return root


def staged_load(spark: SparkSession, d: str):
    """Load the driver model from the intake folder once; returns
    ``(load_results, staging_root)``."""
    from tessera.plans.ingest import load_model
    key = (ensure_checkpoint_dir(spark), d + "#load")
    if key in _CACHE:
        root = _CACHE[key]
        return spark.read.parquet(f"{root}/_load_results"), root
    root = scratch_path(spark, "staging")
    res = load_model(spark, intake(spark, d), M.MODEL, root)
    res.write.parquet(f"{root}/_load_results")
    _CACHE[key] = root
    return spark.read.parquet(f"{root}/_load_results"), root
