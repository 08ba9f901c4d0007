"""The dialect of delimited files: delimiter, quote, escape and skipped rows.

Every line of a file is cut under every candidate (a delimiter, a quote and how a
quote inside a quoted cell is escaped).  One aggregate over the scan counts, for each
file, the lines that are cut alike under all candidates; from those few counts come, for
each file, candidate and number of cells, the lines that have it, the lines with quoted and
with escaped cells, and the first such line of the file's first split.  The
candidate whose most frequent number of cells holds for most lines wins; the
lines before the first line with that number are a preamble that a reader skips.  Nothing
is sampled, and what leaves a task is a few counts for each file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.casting import DATE_SHAPE
from tessera.functions.text import listed_path
from tessera.operators.common import broadcast_checked
from tessera.session import write_read

# Delimiters tried, in order of preference.
DELIMITERS = (",", "|", ";", "\t")
# Quote and escape pairs tried; an empty quote means that quotes are plain characters.
QUOTINGS = (('"', '"'), ('"', "\\"), ("'", "'"), ("'", "\\"), ("", ""))
# Layouts of dates and of times of day that are recognised, as strftime patterns.
DATE_LAYOUTS = (("%Y-%m-%d", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), ("%Y/%m/%d", r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"),
                ("%d/%m/%Y", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), ("%d-%m-%Y", r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"))
TIME_LAYOUTS = (("%H:%M:%S.%f", r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}\.[0-9]+"), ("%H:%M:%S", r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}"),
                ("%H:%M", r"[0-9]{1,2}:[0-9]{2}"))


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    quote: str
    escape: str


CANDIDATES = tuple(Dialect(d, q, e) for q, e in QUOTINGS for d in DELIMITERS)


def _literal(s: str) -> str:
    """A character inside an expression."""
    return {"\t": r"\t"}.get(s, "\\" + s)


def quoted_cell(dialect: Dialect) -> str:
    """A whole quoted cell, the delimiter or the line's end behind it not included."""
    q, e = _literal(dialect.quote), _literal(dialect.escape)
    inside = f"(?:[^{q}]|{q}{q})*+" if dialect.escape == dialect.quote else f"(?:[^{q}{e}]|{e}.)*+"
    return f"(?<=^|{_literal(dialect.delimiter)}){q}{inside}{q}(?={_literal(dialect.delimiter)}|$)"


def _cells(line: Column, delimiter: str) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(delimiter))) + 1).cast("int")


def _code(cells: Column, quoted: Column, escaped: Column) -> Column:
    """cells (-1: quotes do not pair up under this candidate), quoted and escaped as one number."""
    return (cells + 1) * 4 + quoted.cast("int") * 2 + escaped.cast("int")


def _cut(line: Column, dialect: Dialect, plain: Column) -> Column:
    """The line's :func:`_code` under this candidate; ``plain`` are its cells when no quote counts."""
    no = F.lit(False)
    if not dialect.quote:
        return _code(plain, no, no)
    pattern = quoted_cell(dialect)
    inner = r"." + _literal(dialect.escape) + _literal(dialect.quote) + r"."
    held = F.array_join(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), "\n")
    escape = line.contains(dialect.escape + dialect.quote)

    def met(rest):      # what is left of the line without its quoted cells
        quoted = F.length(rest) < F.length(line)
        return _code(F.when(rest.contains(dialect.quote), -1).otherwise(_cells(rest, dialect.delimiter)), quoted,
                     quoted & escape & held.rlike(inner))
    # a one-element array binds the expression, so that it runs once
    bound = F.transform(F.array(F.regexp_replace(line, pattern, "")), met)[0]
    # without a quote where a cell begins, no cell is quoted and the quotes stay
    begins = line.startswith(dialect.quote) | line.contains(dialect.delimiter + dialect.quote)
    return (F.when(~line.contains(dialect.quote), _code(plain, no, no)).when(begins, bound)
            .otherwise(_code(F.lit(-1), no, no)))


def _layouts() -> tuple[list, list]:
    edge = r"(?:^|[^0-9/:.-])"
    dates = [(f, edge + rx + r"(?:$|[^0-9/-])") for f, rx in DATE_LAYOUTS]
    stamps = [(f"{df}{sep}{tf}", edge + dx + (" " if sep == " " else "T") + tx + r"(?:$|[^0-9:.])")
              for df, dx in DATE_LAYOUTS for sep in (" ", "T") for tf, tx in TIME_LAYOUTS]
    return dates, stamps


def _text() -> Column:
    return F.when(F.col("value").endswith("\r"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))


def _holds(line: Column, layout: str) -> Column:
    """The line has the plain characters that the layout needs, which is quicker to see than the layout."""
    return reduce(lambda a, b: a & b, [line.contains(c) for c in "-/:." if c in layout])


def line_counts(lines: DataFrame) -> DataFrame:
    """``lines`` (file, block, value) -> one row for each file and ``codes``, the codes of a line under
    all candidates (NULL: empty lines): their number, the facts of their layouts, and of the first of them
    the place and two hashes, 96 bits, that stand for its text.  Lines of a table cut alike, so a file has few such rows.  One pass; numbers only, so that
    it is a hash aggregate."""
    dates, stamps = _layouts()
    one = lines.select("file", _text().alias("value"), (F.col("block") == 0).alias("lead"), F.monotonically_increasing_id().alias("at"),
                       F.col("value").endswith("\r").alias("cr"),
                       *[_cells(_text(), d).alias(f"_n{i}") for i, d in enumerate(DELIMITERS)],
                       # a first layout that a line holds, if any
                       *[F.coalesce(*[F.when(_holds(F.col("value"), layout) & F.col("value").rlike(rx), F.lit(i))
                                       for i, (layout, rx) in enumerate(known)]).alias(name)
                         for name, known in (("date", dates), ("stamp", stamps))])
    codes = F.array(*[_cut(F.col("value"), c, F.col(f"_n{DELIMITERS.index(c.delimiter)}")) for c in CANDIDATES])
    cut = one.select("file", "cr", "date", "stamp", F.when(F.col("lead"), F.col("at")).alias("lead"),
                     F.xxhash64("value").alias("a"), F.hash("value").alias("b"),
                     F.when(F.trim("value") != "", codes).alias("codes"))
    return cut.groupBy("file", "codes").agg(
        F.count(F.lit(1)).alias("lines"), F.min("lead").alias("first"), F.min_by("a", "lead").alias("a"), F.min_by("b", "lead").alias("b"),
        F.count_if("cr").alias("cr"),
        *[F.count_if(F.col(name) == i).alias(f"{name}_{i}") for name, known in (("date", dates), ("stamp", stamps))
          for i in range(len(known))])


def _most(prefix: str, known: list) -> Column:
    """The layout that most lines hold; earlier ones win ties."""
    counted = F.array(*[F.struct(F.col(f"{prefix}_{i}").alias("n"), F.lit(-i).alias("i"), F.lit(f).alias("f"))
                        for i, (f, _) in enumerate(known)])
    best = F.array_max(counted)
    return F.when(best["n"] > 0, best["f"])


def sniff_dialect(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """One row for each file: ``file, delimiter, quote, escape, newline, skipped_rows, has_header, n_columns, header,
    date_format, timestamp_format, lines, consistent_lines``.

    A quote or an escape is reported only where a cell shows it; a file of one column has the
    delimiter ``,``.  ``skipped_rows`` counts the lines, empty ones too, before the first line
    with the file's number of cells; they must lie in the file's first split.  ``lines`` leaves out
    empty lines."""
    read = spark.read.option("lineSep", "\n").option("encoding", encoding).text(list(paths))
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    counts = write_read(line_counts(lines), "dialect-counts")
    known = [(p, i) for p, k in zip(("date", "stamp"), _layouts()) for i in range(len(k))]
    of_file = counts.groupBy("file").agg(
        F.min("first").alias("start"), F.sum(F.when(F.col("codes").isNotNull(), F.col("lines")).otherwise(0)).alias("total"),
        F.sum("cr").alias("cr"), *[F.sum(f"{p}_{i}").alias(f"{p}_{i}") for p, i in known]).select(
        "file", "start", "total", "cr",
        *[_most(p, k).alias(name) for p, k, name in zip(("date", "stamp"), _layouts(), ("date_format", "timestamp_format"))])
    cut = counts.where("codes IS NOT NULL").select("file", "lines", "first", "a", "b", F.posexplode("codes").alias("candidate", "code"))
    held = lambda bit: F.sum(F.when(F.col("code").bitwiseAND(bit) > 0, F.col("lines")).otherwise(0))
    each = cut.groupBy("file", "candidate", (F.floor(F.col("code") / 4) - 1).cast("int").alias("cells")).agg(
        F.sum("lines").alias("lines"), held(2).alias("quoted"), held(1).alias("escaped"), F.min("first").alias("first"),
        F.min_by("a", "first").alias("a"), F.min_by("b", "first").alias("b"))
    # per candidate its most frequent number of cells, more cells first among equals
    real = F.when(F.col("cells") > 0, F.struct("lines", "cells"))
    per = each.groupBy("file", "candidate").agg(
        F.max_by(F.struct("cells", "lines", "first", "a", "b"), real).alias("m"), F.sum("quoted").alias("quoted"),
        F.sum("escaped").alias("escaped")).where("m IS NOT NULL")
    # several cells before one; then more consistent lines, quoted and escaped cells as evidence, more cells, the list's order
    several = F.col("m.cells") > 1
    order = F.struct(several, F.when(several, F.col("m.lines")).otherwise(0), F.col("escaped") > 0, F.col("quoted") > 0, F.col("m.cells"),
                     -F.col("candidate"))
    best = per.groupBy("file").agg(F.max_by(F.struct("candidate", "m", "quoted", "escaped"), order).alias("b")).select("file", "b.*")
    best = write_read(best, "dialect-best")      # one row a file
    # the text of the first such lines, by their marks
    marks = broadcast_checked(best.where("m.first IS NOT NULL").select(F.col("file").alias("_f"), F.col("m.a").alias("_a"), F.col("m.b").alias("_b")))
    leads = lines.where("block = 0").select("file", _text().alias("first_line"))
    firsts = leads.join(marks, (F.col("file") == F.col("_f")) & (F.xxhash64("first_line") == F.col("_a"))
                        & (F.hash("first_line") == F.col("_b"))).select("file", "first_line").distinct()
    best = best.join(firsts, "file", "left")
    value = lambda part: F.element_at(F.array(*[F.lit(getattr(c, part)) for c in CANDIDATES]), F.col("candidate") + 1)
    out = best.join(of_file, "file").withColumn("delimiter", value("delimiter"))
    names = header_names(F.regexp_replace("first_line", "^\\x{FEFF}", ""), F.col("delimiter"))
    data_like = F.exists(names, lambda n: n.try_cast("double").isNotNull() | n.rlike(DATE_SHAPE))
    return out.select(
        listed_path(F.col("file")).alias("file"), "delimiter", F.when(F.col("quoted") > 0, value("quote")).otherwise("").alias("quote"),
        F.when(F.col("escaped") > 0, value("escape")).otherwise("").alias("escape"),
        F.when(F.col("cr") > 0, F.lit("\\r\\n")).otherwise(F.lit("\\n")).alias("newline"),
        (F.col("m.first") - F.col("start")).alias("skipped_rows"), (~data_like).alias("has_header"),
        F.col("m.cells").alias("n_columns"), F.when(~data_like, names).alias("header"), "date_format", "timestamp_format",
        F.col("total").alias("lines"), F.col("m.lines").alias("consistent_lines"))


def header_names(line: Column, delimiter: Column) -> Column:
    """Cells of a header line without blanks and quotes around them."""
    names = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))
    return F.transform(names, lambda n: F.regexp_replace(F.trim(n), "^[\"']|[\"']$", ""))
