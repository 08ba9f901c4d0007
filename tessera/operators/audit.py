"""Cast audit: which raw cells of which lines do not load as their type.

All audited columns are checked in one scan: each row is exploded into the
(variable, text) pairs that fail, so the cost is one pass however many
columns there are (the reference runs one query per column).

Two modes:

* ``strict`` (default): the cell is not a NULL token and the typed parse
  gives NULL, i.e. the load would refuse it.
* ``roundtrip``: the typed value printed back differs from the text, or
  either is NULL.  This also lists empty cells and castable but
  non-canonical spellings (``01``, ``1.0``, ``TRUE``), as the reference
  does when it explains a failed load.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.casting import NULL_TOKENS, canonical_text, try_parse
from tessera.operators.common import first_n
from tessera.session import ensure_checkpoint_dir

# The audit summary lists this many lines / values, then ", ...".
SUMMARY_ITEMS = 15


def given_cell(raw: F.Column) -> F.Column:
    """The cell is there and no NULL token."""
    return raw.isNotNull() & ~raw.isin(*NULL_TOKENS)


def bad_cell(raw: F.Column, fmt: str, mode: str = "strict") -> F.Column:
    if mode == "strict":
        return given_cell(raw) & try_parse(raw, fmt).isNull()
    if mode == "roundtrip":
        text = F.when(raw != "", raw)   # the all-text scan reads '' as NULL
        back = canonical_text(try_parse(text, fmt), fmt)
        return back.isNull() | text.isNull() | (back != text)
    raise ValueError(f"unknown audit mode {mode!r}")


def cast_audit(raw: DataFrame, formats: Mapping[str, str], line_col: str = "line_number",
               mode: str = "strict") -> DataFrame:
    """``(variable, line_number, value)`` for every failing cell."""
    items = [F.when(bad_cell(F.col(c), fmt, mode),
                    F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")))
             for c, fmt in formats.items()]
    return (raw.select(F.col(line_col).alias("line_number"),
                       F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))
            .select("variable", "line_number", "value"))


def _quoted_list(items: F.Column, total: F.Column, n: int) -> F.Column:
    body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return F.when(total > n, F.concat(body, F.lit(", ..."))).otherwise(body)


def audit_summary(findings: DataFrame, n: int = SUMMARY_ITEMS) -> DataFrame:
    """Per variable: lines, distinct values, first ``n`` lines and values
    (by first appearance), each quoted, ``, ...`` when more.  A NULL cell
    shows as the empty text."""
    # the findings are the bad cells only: fix them once (a reliable
    # checkpoint in the shared folder) so the four reports below read them
    # instead of re-running the audit scan over every cell
    ensure_checkpoint_dir(findings.sparkSession)
    f = (findings.select("variable", "line_number", F.coalesce("value", F.lit("")).alias("value"))
         .checkpoint(eager=True))
    totals = f.groupBy("variable").agg(F.count(F.lit(1)).alias("n_lines"))
    lines = first_n(f, ["variable"], "line_number", F.col("line_number").cast("string"), n, "lines")
    per_value = f.groupBy("variable", "value").agg(F.min("line_number").alias("first_line"))
    nvals = per_value.groupBy("variable").agg(F.count(F.lit(1)).alias("n_values"))
    values = first_n(per_value, ["variable"], "first_line", "value", n, "values")
    return (totals.join(nvals, "variable").join(lines, "variable").join(values, "variable")
            .select("variable", "n_lines", "n_values",
                    _quoted_list(F.col("lines"), F.col("n_lines"), n).alias("line_list"),
                    _quoted_list(F.col("values"), F.col("n_values"), n).alias("value_list")))
