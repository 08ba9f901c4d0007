"""Typed parsing of raw text cells, all as built-in Column expressions.

Everything here stays inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import FORMAT_TYPES, normalize_format

# Cell texts that load as NULL.
NULL_TOKENS = ("NA", "")

# Shapes a text must have before the engine cast is tried, so the
# accepted inputs follow the reference dialect rather than Spark's laxer one.
# A time may carry a zone; it is accepted and not applied.
_TIME = r"[ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
_ZONE = r"\s*(Z|UTC|[+-][0-9]{2}(:?[0-9]{2})?)"
DATE_SHAPE = r"^\s*[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(" + _TIME + "(" + _ZONE + r")?)?\s*$"
DATETIME_SHAPE = DATE_SHAPE
ZONE_SUFFIX = "(:[0-9.]+)" + _ZONE + r"\s*$"
# Day, month, year: a layout that the load reads in date columns.
DAY_FIRST = r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s*$"
DOUBLE_SUFFIX = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]\s*$"
# Texts that need none of the rewriting above; tried first, as nearly every cell is one.
PLAIN_STAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}:[0-9]{2})?\z"


def null_tokens(raw: Column) -> Column:
    """NULL for a missing cell or a null token, the text otherwise."""
    return F.when(raw.isNull() | raw.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(raw)


def try_parse(raw: Column, fmt: str) -> Column:
    """Cast a text cell to the staging type of ``fmt``; NULL when not castable."""
    fmt = normalize_format(fmt)
    if fmt == "string":
        return raw
    if fmt in ("date", "datetime"):
        fixed = F.regexp_replace(F.regexp_replace(F.trim(raw), "/", "-"), ZONE_SUFFIX, "$1")
        stamp = F.when(raw.rlike(PLAIN_STAMP), raw.try_cast("timestamp_ntz")).when(
            raw.rlike(DATE_SHAPE if fmt == "date" else DATETIME_SHAPE), fixed.try_cast("timestamp_ntz"))
        return stamp.cast("date") if fmt == "date" else stamp
    if fmt == "double":   # no text that ends in a digit has a type suffix
        return F.when(F.substring(raw, -1, 1).between("0", "9") | ~raw.rlike(DOUBLE_SUFFIX), raw.try_cast("double"))
    if fmt == "integer":  # most are plain 64-bit numbers, which need no big decimal to be read
        short = raw.try_cast("bigint")
        return F.when(short.cast("string") == raw, short.cast(FORMAT_TYPES[fmt])).otherwise(raw.try_cast(FORMAT_TYPES[fmt]))
    return raw.try_cast(FORMAT_TYPES[fmt])


def iso_date(raw: Column, fmt: str) -> Column:
    """Day-first dates of a date or datetime column in year-first order; other texts unchanged."""
    if normalize_format(fmt) not in ("date", "datetime"):
        return raw
    return F.when(raw.contains("/"), F.regexp_replace(raw, DAY_FIRST, "$3-$2-$1")).otherwise(raw)


def typed_cell(raw: Column, fmt: str) -> Column:
    """Null tokens first, then the typed parse (the load path)."""
    return try_parse(null_tokens(raw), fmt)


def _shortest_sci(x: Column) -> Column:
    """``d.ddde±NN`` with the fewest significant digits (15, 16 or 17) that
    read back as the same double.  (The JVM's own double-to-text is not
    always the shortest before Java 19.)"""
    a = F.abs(x)

    def first_exact(precisions):
        ok = F.filter(F.array(*[F.format_string(f"%.{p - 1}e", a) for p in precisions]),
                      lambda c: c.cast("double") == a)
        return F.coalesce(F.try_element_at(ok, F.lit(1)), F.format_string("%.16e", a))
    # a normal double always round-trips at 15 digits when a shorter form
    # does; subnormals carry fewer bits and are searched from one digit up
    return F.when(a < F.lit(2.2250738585072014e-308), first_exact(range(1, 17))).otherwise(first_exact((15, 16)))


def _layout(p: Column) -> Column:
    """Python-style text from a struct of (lead digit, fraction digits,
    exponent): plain while -4 <= exp < 16, else ``d.ddde±NN``."""
    lead, frac, exp = p["lead"], p["frac"], p["exp"]
    digits = F.concat(lead, frac)
    nfrac = F.length(frac)
    pos_plain = F.when(nfrac <= exp, F.concat(digits, F.repeat(F.lit("0"), exp - nfrac), F.lit(".0"))).otherwise(
        F.concat(digits.substr(F.lit(1), exp + 1), F.lit("."), digits.substr(exp + 2, F.lit(10000))))
    neg_plain = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    mant = F.when(frac == "", lead).otherwise(F.concat(lead, F.lit("."), frac))
    mag = F.abs(exp).cast("string")
    exp_txt = F.concat(F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                       F.when(F.abs(exp) < 10, F.concat(F.lit("0"), mag)).otherwise(mag))
    return (F.when((exp >= 0) & (exp < 16), pos_plain)
            .when((exp < 0) & (exp >= -4), neg_plain)
            .otherwise(F.concat(mant, F.lit("e"), exp_txt)))


def _double_text(d: Column) -> Column:
    """Render a double the way the reference's engine prints it.

    Shortest round-trip digits, plain notation while 1e-4 <= |x| < 1e16,
    otherwise ``1e+16`` / ``1.5e-05`` style; ``nan``, ``inf``, ``-inf``.
    Intermediate values are bound once through lambda variables, so the
    expression stays small however often they are used.
    """
    parsed = F.transform(F.array(_shortest_sci(d)), lambda s: F.struct(
        F.regexp_extract(s, r"^([0-9])", 1).alias("lead"),
        F.regexp_replace(F.regexp_extract(s, r"^[0-9]\.?([0-9]*)e", 1), "0+$", "").alias("frac"),
        F.regexp_extract(s, r"e([-+][0-9]+)$", 1).cast("int").alias("exp")))
    body = F.try_element_at(F.transform(parsed, _layout), F.lit(1))
    sign = F.when(d.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))   # keeps -0.0
    # The engine's own text of a number it prints plainly reads back as that number.  Two texts of at
    # most 15 significant digits never name one double, so one that short is the shortest.
    own, size = d.cast("string"), F.abs(d)
    short = ((size >= 1e-3) & (size < 1e7) & (F.length(own) <= 16)
             & (own.endswith(".0") | ~own.endswith("0")))
    special = (F.when(short, own).when(F.isnan(d), F.lit("nan"))
               .when(d == float("inf"), F.lit("inf"))
               .when(d == float("-inf"), F.lit("-inf"))
               .when(d == 0, F.concat(sign, F.lit("0.0"))))
    return F.coalesce(special, F.when(d.isNotNull(), F.concat(sign, body)))


def canonical_text(typed: Column, fmt: str) -> Column:
    """The text form of a typed value, for the round-trip cast audit."""
    fmt = normalize_format(fmt)
    if fmt == "double":
        return _double_text(typed)
    return typed.cast("string")
