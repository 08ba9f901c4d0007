"""How the driver's tables play the roles of the data model.

The driver tables carry no NULLs, no dirty text and no orphans, so each
entity here is a *view* that Spark derives from a whole table: NULLs by
``nullif`` on real values, orphans by a parent restricted on a real column
(pending orders are not yet in the parent), dirty text by rewriting some
cells.  Every row of every table is read; nothing is sampled or capped.

Each view exists twice, as DataFrame code and as the SQL text the oracle
runs, and both are kept next to each other here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import DataModel, Entity, ForeignKey, Rule, Variable, CatalogRef
from tessera.operators.common import number_rows
from tessera.session import ensure_checkpoint_dir


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def numbered(spark: SparkSession, d: str, name: str, order: list[str]) -> DataFrame:
    """The table with its line numbers, staged once per session and table
    folder in the shared checkpoint folder: :func:`number_rows` stores the sorted rows, whose
    ids and the offsets of their partitions fix every line number."""
    key = (ensure_checkpoint_dir(spark), d, name)
    if key not in _STAGED or _STAGED[key].sparkSession is not spark:
        _STAGED[key] = number_rows(table(spark, d, name), order)
    return _STAGED[key]


# The rules, code lists and orders used by the driver model.
LINEITEM_RULES = [
    "l_discount between 0 and 0.08",
    "l_quantity < 45 or l_tax < 0.05",
    "l_extendedprice / l_quantity < 2000",
]
ORDERS_RULES = ["o_totalprice > 1000"]
EVENTS_RULES = ["value >= 1"]
PRIORITY_CODES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
RETURNFLAG_CODES = ["A", "N"]
EVENT_TYPE_CODES = ["click", "purchase", "signup", "view"]
# Line order of lineitem: all columns, so ties cannot reorder rows.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# Line order of each validated table: the order that :func:`numbered` sorts by.
LINE_ORDER = {"orders": ["o_orderkey"], "lineitem": LINEITEM_ORDER, "events": ["event_id"], "nation": ["n_nationkey"]}
# Orders still pending ('P') are not yet in the parent table.
PARENT_STATUSES = ["F", "O"]

# A rule that raises at run time under ANSI (division by zero on every row).
ERROR_RULES = [
    "l_discount between 0 and 0.08",
    "l_quantity / (l_linenumber - l_linenumber) > 1",
    "no_such_column > 0",
    "l_quantity < 45 or l_tax < 0.05",
]


def _v(label, fmt, typ=None, catalog=None):
    return Variable(label, fmt, typ, catalog is not None, CatalogRef(catalog, "code") if catalog else None)


ORDERS = Entity("orders", [
    _v("o_orderkey", "integer"), _v("o_custkey", "integer"), _v("o_orderstatus", "string", "Categorical"),
    _v("o_totalprice", "double"), _v("o_orderdate", "datetime"),
    _v("o_orderpriority", "string", "Categorical", "priority"),
], [Rule(r) for r in ORDERS_RULES], ("o_orderkey",), [], 0)

LINEITEM = Entity("lineitem", [
    _v("l_orderkey", "integer"), _v("l_linenumber", "integer"), _v("l_partkey", "integer"),
    _v("l_suppkey", "integer"), _v("l_quantity", "double"), _v("l_extendedprice", "double"),
    _v("l_discount", "double"), _v("l_tax", "double"), _v("l_returnflag", "string", "Categorical", "returnflag"),
    _v("l_linestatus", "string", "Categorical"), _v("l_shipdate", "datetime"),
    # no primary key: the driver table repeats (l_orderkey, l_linenumber), and a load enforces declared keys
], [Rule(r) for r in LINEITEM_RULES], (),
    [ForeignKey(("l_orderkey",), "orders", ("o_orderkey",))], 1)

EVENTS = Entity("events", [
    _v("event_id", "integer"), _v("ts", "datetime"), _v("user_id", "integer"),
    _v("event_type", "string", "Categorical", "event_type"), _v("value", "double"), _v("props", "string"),
], [Rule(r) for r in EVENTS_RULES], ("event_id",), [], 2)

NATION = Entity("nation", [
    _v("n_nationkey", "integer"), _v("n_name", "string"), _v("n_regionkey", "integer", "Categorical", "region"),
], [], ("n_nationkey",), [], 3)

CUSTOMER = Entity("customer", [
    _v("c_custkey", "integer"), _v("c_name", "string"), _v("c_nationkey", "integer"),
    _v("c_acctbal", "double"), _v("c_mktsegment", "string", "Categorical"),
], [], ("c_custkey",), [], 4)

MODEL = DataModel([ORDERS, LINEITEM, EVENTS, NATION, CUSTOMER],
                  metadata={"use_case": "driver tables", "project": "driver"}, version="1")


# ------------------------------------------------------------ entity views
def orders_view(spark: SparkSession, d: str, *more: F.Column) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"), *more)


ORDERS_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
              "nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders")


def lineitem_view(spark: SparkSession, d: str, *more: F.Column) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", F.expr("nullif(l_linenumber, 7)").alias("l_linenumber"), "l_partkey",
                     "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                     F.expr("nullif(l_tax, 0)").alias("l_tax"), "l_returnflag", "l_linestatus", "l_shipdate", *more)


LINEITEM_SQL = ("SELECT l_orderkey, nullif(l_linenumber, 7) AS l_linenumber, l_partkey, l_suppkey, l_quantity, "
                "l_extendedprice, l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag, l_linestatus, l_shipdate "
                "FROM lineitem")


def lineitem_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lineitem view with its stored line number (file order = key order)."""
    li = numbered(spark, d, "lineitem", LINE_ORDER["lineitem"])
    return li.select("line_number", "l_orderkey", F.expr("nullif(l_linenumber, 7)").alias("l_linenumber"),
                     "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                     F.expr("nullif(l_tax, 0)").alias("l_tax"), "l_returnflag", "l_linestatus", "l_shipdate")


LINEITEM_LINES_SQL = (
    f"SELECT row_number() OVER (ORDER BY {', '.join(LINEITEM_ORDER)}) AS line_number, "
    "l_orderkey, nullif(l_linenumber, 7) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")


def orders_lines(spark: SparkSession, d: str) -> DataFrame:
    o = numbered(spark, d, "orders", LINE_ORDER["orders"])
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"), "line_number")


ORDERS_LINES_SQL = (f"SELECT row_number() OVER (ORDER BY o_orderkey) AS line_number, * FROM ({ORDERS_SQL})")


def events_lines(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d, "events", LINE_ORDER["events"])


EVENTS_LINES_SQL = "SELECT row_number() OVER (ORDER BY event_id) AS line_number, * FROM events"


def nation_lines(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d, "nation", LINE_ORDER["nation"])


NATION_LINES_SQL = "SELECT row_number() OVER (ORDER BY n_nationkey) AS line_number, * FROM nation"


def ordered_view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The view of an entity with the place of its rows, ``line_order``, from the table's own values: what its
    ``*_lines`` view has as ``line_number``, without sorting the table."""
    place = F.struct(*LINE_ORDER[name]).alias("line_order")
    views = {"orders": orders_view, "lineitem": lineitem_view}
    return views[name](spark, d, place) if name in views else table(spark, d, name).select("*", place)


def parent_orders(spark: SparkSession, d: str) -> DataFrame:
    """The parent table as published: orders that are no longer pending."""
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin(*PARENT_STATUSES))


PARENT_SQL = "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')"


def code_list(spark: SparkSession, codes: list) -> DataFrame:
    """A code list as a catalog DataFrame (``code``, ``description``)."""
    return spark.createDataFrame([(str(c), f"code {c}") for c in codes], "code string, description string")


def catalogs_for(spark: SparkSession, d: str, entity: str) -> dict[str, DataFrame]:
    if entity == "orders":
        return {"o_orderpriority": code_list(spark, PRIORITY_CODES)}
    if entity == "lineitem":
        return {"l_returnflag": code_list(spark, RETURNFLAG_CODES)}
    if entity == "events":
        return {"event_type": code_list(spark, EVENT_TYPE_CODES)}
    if entity == "nation":
        return {"n_regionkey": table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("code"),
                                                                F.col("r_name").alias("description"))}
    return {}


def catalog_sizes(entity: str) -> dict[str, int]:
    """Known sizes of the literal code lists (the region table is counted)."""
    return {"orders": {"o_orderpriority": len(PRIORITY_CODES)}, "lineitem": {"l_returnflag": len(RETURNFLAG_CODES)},
            "events": {"event_type": len(EVENT_TYPE_CODES)}}.get(entity, {})


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# ------------------------------------------------------------- dirty text
# Orders rendered to text cells with defects written into some of them: null
# tokens, a leading zero, letters, a double with a type suffix, dates with
# slashes and an impossible date.  Every order is rendered.
DIRTY_FORMATS = {"o_orderkey": "integer", "o_totalprice": "double", "o_orderdate": "date"}


def dirty_orders(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions.casting import canonical_text
    o = numbered(spark, d, "orders", LINE_ORDER["orders"])
    k = F.col("o_orderkey")
    key = F.col("o_orderkey").cast("string")
    price = canonical_text(F.col("o_totalprice"), "double")
    day = F.col("o_orderdate").cast("date").cast("string")
    return o.select(
        "line_number",
        F.when(k % 97 == 0, F.lit("NA")).when(k % 89 == 0, F.lit("")).when(k % 83 == 0, F.concat(F.lit("0"), key))
         .when(k % 79 == 0, F.lit("x")).otherwise(key).alias("o_orderkey"),
        F.when(k % 101 == 0, F.concat(price, F.lit("d"))).otherwise(price).alias("o_totalprice"),
        F.when(k % 103 == 0, F.regexp_replace(day, "-", "/")).when(k % 107 == 0, F.lit("2020-13-45"))
         .otherwise(day).alias("o_orderdate"))


DIRTY_ORDERS_SQL = (
    "SELECT row_number() OVER (ORDER BY o_orderkey) AS line_number, "
    "CASE WHEN o_orderkey % 97 = 0 THEN 'NA' WHEN o_orderkey % 89 = 0 THEN '' "
    "WHEN o_orderkey % 83 = 0 THEN concat('0', CAST(o_orderkey AS VARCHAR)) WHEN o_orderkey % 79 = 0 THEN 'x' "
    "ELSE CAST(o_orderkey AS VARCHAR) END AS o_orderkey, "
    "CASE WHEN o_orderkey % 101 = 0 THEN concat(CAST(o_totalprice AS VARCHAR), 'd') "
    "ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice, "
    "CASE WHEN o_orderkey % 103 = 0 THEN replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', '/') "
    "WHEN o_orderkey % 107 = 0 THEN '2020-13-45' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS o_orderdate "
    "FROM orders")

DUCK_TYPES = {"integer": "HUGEINT", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "datetime": "TIMESTAMP"}
