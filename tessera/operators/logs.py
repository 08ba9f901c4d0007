"""Structured results from load logs, as Spark jobs over many log files.

Logs are read with the ``text`` source; line order comes from the stored
file line numbers.  Each line is classified with ``regexp_extract``; the
entity a "records read" line belongs to is carried forward from the last
"table" line of the same file, and cast-error blocks are numbered by a
running count of their first lines.

What is carried never needs a whole log in one task.  Lines are dealt into chunks
of ``CHUNK`` lines of a file; inside a chunk the last event and the running count
come from a window over that chunk, one summary row a chunk gives what it hands
on, and the summaries of a file are carried the same way, level by level, until one
chunk holds all that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_ansi
from tessera.session import write_read

# Lines, or summaries of chunks, of one file that a window holds together.
CHUNK = 10_000

# The log lines recognised.
MISSING_LINE = r'No file.*configuration of the "([\w ]+)" entity'
TABLE_LINE = r'table "([\w ]+)"'
RECORDS_LINE = r"(?:INFO|ERROR):: (\d+) records read"
BLOCK_START = r"ERROR:: Checking variable: (.*)$"
FILENAME_LINE = r"ERROR:: Filename: (.*)$"
COUNT_LINE = r"Found casting errors in (\d+) line"
EXAMPLES_LINE = r"Example of erroneous values found: (.*)$"


def _classified(lines: DataFrame) -> DataFrame:
    """``lines``: (file, line, text).  Adds the matches of every pattern."""
    t = strip_ansi(F.col("text"))
    def grab(p):
        return F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return lines.select("file", "line", grab(MISSING_LINE).alias("missing"), grab(TABLE_LINE).alias("table"),
                        grab(RECORDS_LINE).cast("long").alias("records"), grab(BLOCK_START).alias("variable"),
                        grab(FILENAME_LINE).alias("filename"), grab(COUNT_LINE).cast("long").alias("n_lines"),
                        grab(EXAMPLES_LINE).alias("examples"))


def carry_forward(events: DataFrame, value: str, count: str, chunk: int | None = None) -> DataFrame:
    """``events`` (file, line, ``value``, ``count``, ...) with ``value`` filled from the last row of the file
    that has one and ``count`` summed up to each row, both in line order.  ``line`` counts from 1 in each file."""
    chunk = chunk or CHUNK
    rows = write_read(events.withColumn("_chunk", F.floor((F.col("line") - 1) / chunk).cast("long")), "events")
    inside = Window.partitionBy("file", "_chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    filled = (rows.withColumn(value, F.last(value, ignorenulls=True).over(inside))
              .withColumn(count, F.sum(count).over(inside)))
    if rows.where("_chunk > 0").limit(1).count() == 0:
        return filled.drop("_chunk")
    # one row a chunk: what it hands on; chunks are the lines of the next level
    handed = rows.groupBy("file", "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line"))).alias("_v"),
                                                F.sum(count).alias("_n"))
    level = carry_forward(handed.select("file", (F.col("_chunk") + 1).alias("line"), "_v", "_n"), "_v", "_n", chunk)
    # up to and with the chunk before
    before = level.select("file", F.col("line").alias("_chunk"), F.col("_v").alias("_before"), F.col("_n").alias("_sum"))
    return (filled.join(before, ["file", "_chunk"], "left")
            .withColumn(value, F.coalesce(value, "_before")).withColumn(count, F.col(count) + F.coalesce("_sum", F.lit(0)))
            .drop("_chunk", "_before", "_sum"))


def load_results(lines: DataFrame, chunk: int | None = None) -> DataFrame:
    """``(file, entity, status, total_records)`` per log file and entity."""
    told = _classified(lines).withColumn("_n", F.lit(0).cast("long"))
    events = told.select("file", "line", "missing", "records", F.col("table").alias("entity"), "_n")
    c = carry_forward(events, "entity", "_n", chunk)
    missing = c.where(F.col("missing").isNotNull()).select("file", F.col("missing").alias("entity"), "line",
                                                           F.lit("missing").alias("status"),
                                                           F.lit(0).cast("long").alias("total_records"))
    read = (c.where(F.col("records").isNotNull() & F.col("entity").isNotNull())
            .select("file", "entity", "line", F.when(F.col("records") > 0, F.lit("success"))
                    .otherwise(F.lit("fatal")).alias("status"), F.col("records").cast("long").alias("total_records")))
    # the last event of an entity in a log decides
    last = missing.unionByName(read).groupBy("file", "entity").agg(
        F.max_by(F.struct("status", "total_records"), "line").alias("_e"))
    return last.select("file", "entity", "_e.status", "_e.total_records")


def cast_errors(lines: DataFrame, chunk: int | None = None) -> DataFrame:
    """``(file, variable, filename, affected_rows, examples)`` per error block."""
    told = _classified(lines).withColumn("block", F.when(F.col("variable").isNotNull(), 1).otherwise(0).cast("long"))
    c = carry_forward(told.select("file", "line", "variable", "filename", "n_lines", "examples", "block",
                                  F.lit(None).cast("string").alias("_v0")), "_v0", "block", chunk)
    return (c.where(F.col("block") > 0).groupBy("file", "block")
            .agg(F.max("variable").alias("variable"), F.max("filename").alias("filename"),
                 F.max("n_lines").alias("affected_rows"), F.max("examples").alias("examples"))
            .where(F.col("affected_rows") > 0).drop("block"))
