"""Delimited files -> typed entity tables.

* Headers are read without scanning data: a take on each file's first split.
* Files are grouped by their exact header order and separator, and each group is read
  with its own all-text schema, then projected to the declared order and
  unioned by name.  (One multi-file read with mixed orders would put values
  into the wrong columns.)
* Cells are parsed with the null tokens and the type dialect of
  :mod:`tessera.functions.casting`; line numbers come from the scan's file
  metadata and are stored with the rows (see
  :func:`tessera.operators.common.number_splits`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.casting import DATE_SHAPE, NULL_TOKENS, try_parse, typed_cell
from tessera.functions.text import first_line, infer_separator, scanned_path
from tessera.model import DataModel, Entity
from tessera.operators.common import broadcast_checked
from tessera.session import write_read

# Header jobs that run side by side; each starts one task on one file.
HEADER_JOBS = 8


def list_files(spark: SparkSession, root: str, pattern: str = "*.csv", modified_after: str | None = None) -> list[str]:
    """Paths of matching files below ``root`` (a file listing, no data read)."""
    reader = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", pattern))
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return sorted(r["path"] for r in reader.load(root).select("path").collect())


def file_headers(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """``(file, header, separator)``: the first line of every file that is not empty.

    Only lines of a file's first split qualify and a take reads the first split
    only, so the header is right for a file of any size and one task per file
    is started, from a bounded pool.  One row per file comes back; a file
    without such a line has no row.
    """
    def first(path: str):
        lines = spark.read.option("encoding", encoding).text(path)
        return (lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
                .select(scanned_path().alias("file"), F.col("value").alias("header")).head())

    with ThreadPool(HEADER_JOBS) as pool:
        rows = [(r["file"], r["header"]) for r in pool.map(first, paths) if r is not None]
    heads = spark.createDataFrame(rows, "file string, header string")
    header = F.regexp_replace(first_line(F.col("header")), "^\\x{FEFF}", "")
    return heads.select("file", header.alias("header")).withColumn("separator", infer_separator(F.col("header")))


def split_header(header: F.Column, sep: F.Column) -> F.Column:
    """Column names of a header line: split on the separator, quotes and
    blanks around each name removed."""
    names = F.split(header, F.concat(F.lit("\\Q"), sep, F.lit("\\E")))
    return F.transform(names, lambda n: F.regexp_replace(F.trim(n), '^"|"$', ""))


def header_matches(headers: DataFrame, model: DataModel) -> DataFrame:
    """``(file, columns, entity)`` for each file and each entity whose column
    *set* and count equal the file's (a file may feed several entities);
    ``entity`` is NULL when none matches."""
    spark = headers.sparkSession
    ents = spark.createDataFrame([(e.name, sorted(e.labels)) for e in model.entities],
                                 "entity string, key array<string>")
    files = headers.select("file", split_header(F.col("header"), F.col("separator")).alias("columns"))
    files = files.withColumn("key", F.array_sort("columns"))
    return (files.join(F.broadcast(ents), "key", "left").select("file", "columns", "entity"))


@dataclass
class ScanGroup:
    columns: list[str]
    files: list[str]
    sep: str = "|"
    quote: str = '"'
    escape: str = '"'
    skip: int = 0        # lines before the header


def header_groups(headers: DataFrame, entity: Entity) -> list[ScanGroup]:
    """Files of ``entity`` grouped by exact header order and dialect: the separator and, from
    :func:`dialect_headers`, quote, escape and skipped rows (driver-side file metadata only: one row per file)."""
    key = sorted(entity.labels)
    dialect = ["separator", *(c for c in ("quote", "escape", "skipped_rows") if c in headers.columns)]
    rows = (headers.select("file", *dialect, split_header(F.col("header"), F.col("separator")).alias("columns"))
            .where(F.array_sort("columns") == F.array(*[F.lit(k) for k in key])).collect())
    groups: dict[tuple, list[str]] = {}
    for r in rows:
        groups.setdefault((tuple(r["columns"]), *(r[c] for c in dialect)), []).append(r["file"])
    return [ScanGroup(list(cols), sorted(files), *rest)
            for (cols, *rest), files in sorted(groups.items(), key=lambda kv: min(kv[1]))]


def dialect_headers(found: DataFrame) -> DataFrame:
    """Headers for a load from the dialects that :func:`tessera.sources.dialect.sniff_dialect` found:
    ``file, header, separator, quote, escape, skipped_rows`` of the files with a header line.  Where no cell
    shows a quote or an escape, the double quote stands."""
    shown = lambda c: F.when(F.col(c) == "", F.lit('"')).otherwise(F.col(c)).alias(c)
    return found.where("has_header").select(
        "file", F.expr("array_join(header, delimiter)").alias("header"), F.col("delimiter").alias("separator"),
        shown("quote"), shown("escape"), F.col("skipped_rows").cast("int").alias("skipped_rows"))


def scan_text(spark: SparkSession, groups: Sequence[ScanGroup], labels: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """All-text rows of files, one a line, in declared order, in one read of the text.

    Next to the cells: ``_file``, ``_block``, ``_ragged`` (too few or too many cells), ``_invalid``
    (bytes that are not UTF-8), ``_open`` (an odd number of quotes: some cell spans lines), ``_skip``
    (the place of the header line in files with a preamble, else NULL) and ``_blank``.

    Each group is parsed in its own dialect and stays splittable.  Every line comes back, the header
    too, but empty lines only where a preamble is counted; :func:`data_rows` leaves the rows.  Quoted ``""`` reads as
    the empty text and a bare empty cell as NULL; both are null tokens later.  ``NA`` is kept as text here.
    """
    out = None
    for g in groups:
        ddl = ", ".join(f"`{c}` string" for c in [*g.columns, "_corrupt"])
        options = {"sep": g.sep, "quote": g.quote, "escape": g.escape, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
        lines = spark.read.option("encoding", encoding).text(g.files).select(
            "value", (F.trim("value") == "").alias("_blank"), scanned_path().alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"))
        if not g.skip:
            lines = lines.where("NOT _blank")
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(g.quote)))
        invalid = ~F.is_valid_utf8("value") if encoding == "UTF-8" else F.lit(False)
        df = (lines.select("*", F.from_csv("value", ddl, options).alias("_c"))
              .select(*[F.col(f"_c.`{c}`").alias(c) for c in labels], F.col("_c._corrupt").isNotNull().alias("_ragged"),
                      "_file", "_block", F.lit(g.skip or None).cast("int").alias("_skip"), "_blank", invalid.alias("_invalid"),
                      (quotes % 2 == 1).alias("_open")))
        out = df if out is None else out.unionByName(df)
    return out


def csv_rows(spark: SparkSession, groups: Sequence[ScanGroup], labels: Sequence[str], encoding: str = "UTF-8",
             spanning: Sequence[str] | None = None) -> DataFrame:
    """Rows, without headers, as the CSV reader gives them; columns as :func:`scan_text`.  With ``spanning``
    only these files, whose cells hold line breaks, each read whole by one task."""
    out, wanted = None, None if spanning is None else set(spanning)
    for g in groups:
        mine = [f for f in g.files if wanted is None or f in wanted]
        if not mine:
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*g.columns, "_corrupt"]])
        df = (spark.read.schema(schema).option("header", True).option("sep", g.sep).option("encoding", encoding)
              .option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
              .option("quote", g.quote).option("escape", g.escape).option("multiLine", wanted is not None).csv(mine)
              .select(*labels, F.col("_corrupt").isNotNull().alias("_ragged"), scanned_path().alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"), F.lit(None).cast("int").alias("_skip"),
                      F.lit(False).alias("_blank"), F.lit(False).alias("_invalid"), F.lit(False).alias("_open")))
        out = df if out is None else out.unionByName(df)
    return out


def data_rows(stored: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Rows stored by :func:`tessera.operators.common.store_splits` without the header lines: the first
    line of each file's first split; ``heads`` (``_split, _head``) has their ids, if already known."""
    if heads is None:
        heads = stored.where("_block = 0").groupBy("_split").agg(F.min("_mid").alias("_head"))     # one row a file
    return (stored.join(broadcast_checked(heads), "_split", "left").where("_head IS NULL OR _mid > _head").drop("_head"))


def after_preamble(stored: DataFrame) -> DataFrame:
    """Rows stored by :func:`tessera.operators.common.store_splits` without preambles, header
    and empty lines; ``_mid`` counts the rows that are left in each split, a bounded piece of a file."""
    lead = stored.where("_block = 0 AND _skip IS NOT NULL").groupBy("_file").agg(F.min("_mid").alias("_first"))
    kept = (stored.join(broadcast_checked(lead), "_file", "left")
            .where("NOT _blank AND (_skip IS NULL OR _block > 0 OR _mid - _first > _skip)").drop("_first"))
    return write_read(kept.withColumn("_mid", F.row_number().over(Window.partitionBy("_split").orderBy("_mid")).cast("long")),
                      "after-preamble")


def typed(raw: DataFrame, entity: Entity, keep: Sequence[str] = ("line_number",)) -> DataFrame:
    """Typed columns in declared order (null tokens -> NULL, dialect casts)."""
    return raw.select(*keep, *[typed_cell(F.col(v.label), v.fmt).alias(v.label) for v in entity.variables])


def bad_cells(raw: DataFrame, entity: Entity) -> F.Column:
    """Number of cells in the row that are not null tokens and do not parse."""
    terms = [F.when(F.col(v.label).isNotNull() & ~F.col(v.label).isin(*NULL_TOKENS)
                    & try_parse(F.col(v.label), v.fmt).isNull(), 1).otherwise(0) for v in entity.variables]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


# ------------------------------------------------------------ file sniffing
# Candidate types tried in order when sniffing a column.
SNIFF_ORDER = ("boolean", "integer", "double", "date", "datetime")
INTEGER_SHAPE = r"^\s*[+-]?[0-9]+\s*$"
BOOLEAN_SHAPE = r"(?i)^\s*(true|false)\s*$"


def sniff(raw: DataFrame, columns: Sequence[str], group_col: str = "_file") -> DataFrame:
    """Per group (file) and column: the narrowest type every non-null cell
    parses as (``string`` when none).  One aggregate over all columns."""
    aggs = []
    for c in columns:
        v = F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c))
        aggs.append(F.count(v).alias(f"{c}__n"))
        for t in SNIFF_ORDER:
            parsed = try_parse(v, t)
            if t == "integer":   # a sniffed integer has no fraction part
                parsed = F.when(v.rlike(INTEGER_SHAPE), parsed)
            if t == "date":      # a text with a time of day is a datetime
                parsed = F.when(~v.contains(":"), parsed)
            if t == "boolean":   # single letters are not evidence of booleans
                parsed = F.when(v.rlike(BOOLEAN_SHAPE), parsed)
            aggs.append(F.count(parsed).alias(f"{c}__{t}"))
    counts = raw.groupBy(group_col).agg(*aggs)
    structs = []
    for i, c in enumerate(columns):
        kind = F.lit("string")
        for t in reversed(SNIFF_ORDER):
            kind = F.when((F.col(f"{c}__n") > 0) & (F.col(f"{c}__{t}") == F.col(f"{c}__n")), F.lit(t)).otherwise(kind)
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), kind.alias("type")))
    return counts.select(group_col, F.inline(F.array(*structs)))


def read_catalog(spark: SparkSession, path: str, encoding: str | None = None,
                 column_name: str | None = None) -> DataFrame:
    """A code list file: separator from its header line, all text, no null
    token (``NA`` may be a real description); rows without a code in
    ``column_name`` (the first column without it) are dropped."""
    if encoding is None:   # UTF-8 when every line is valid UTF-8, else the single-byte fallback
        from tessera.sources.files import encoding_check
        encoding = encoding_check(spark, path).first()["encoding"]
    enc = encoding
    head = file_headers(spark, [path], enc).first()
    sep = head["separator"] if head else "|"
    df = (spark.read.option("header", True).option("sep", sep).option("encoding", enc)
          .option("nullValue", None).csv(path))
    code = df.columns[0] if column_name is None else column_name
    return df.where(F.col(f"`{code}`").isNotNull() & (F.trim(f"`{code}`") != ""))


# Date layouts recognised by the sniffer, as strftime patterns.
DATE_LAYOUTS = (("%Y-%m-%d", r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), ("%Y/%m/%d", r"^\s*[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"),
                ("%d/%m/%Y", r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"))


def sniff_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file: delimiter, quote, newline, header flag, column count and
    date layout, from one aggregate over a text scan of every line.

    The header flag is set when no name of the first line parses as a number
    or a date (a data row would); the date layout is the first of the known
    layouts seen in the file.  Lines are split on ``\n`` only, so a ``\r``
    before it stays visible."""
    lines = (spark.read.option("lineSep", "\n").text(list(paths))
             .select(scanned_path().alias("file"), "value"))
    # a cell of a date layout anywhere in the line (at the start or after a delimiter)
    layout_counts = [F.count_if(F.col("value").rlike(r"(^|[^0-9/-])" + rx.replace(r"^\s*", "")))
                     .alias(f"_d{i}") for i, (_, rx) in enumerate(DATE_LAYOUTS)]
    per_file = lines.groupBy("file").agg(
        F.count_if(F.col("value").endswith("\r")).alias("_cr"),
        F.count_if(F.col("value").contains('"')).alias("_quoted"),
        *layout_counts)
    heads = file_headers(spark, list(paths))
    names = split_header(F.col("header"), F.col("separator"))
    numeric_or_date = F.exists(names, lambda n: n.try_cast("double").isNotNull() | n.rlike(DATE_SHAPE))
    heads = heads.select("file", F.col("separator").alias("delimiter"), F.size(names).alias("n_columns"),
                         (~numeric_or_date).alias("has_header"))
    layout = F.lit(None).cast("string")
    for i, (fmt, _) in reversed(list(enumerate(DATE_LAYOUTS))):
        layout = F.when(F.col(f"_d{i}") > 0, F.lit(fmt)).otherwise(layout)
    return (per_file.join(heads, "file")
            .select("file", "delimiter", F.when(F.col("_quoted") > 0, F.lit('"')).otherwise(F.lit("")).alias("quote"),
                    F.when(F.col("_cr") > 0, F.lit("\\r\\n")).otherwise(F.lit("\\n")).alias("newline"),
                    "has_header", "n_columns", layout.alias("date_format")))
