"""Small scalar helpers over text, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal colour codes removed from log lines.
ANSI_CODE = r"\x1b\[[0-9;]*[mK]"

# Characters that can belong to a column name; what is left of a
# header line after deleting runs of them (and their quotes) starts with the
# separator.  Default separator when nothing is left.
NAME_RUN = "\"*[?a-zA-ZÀ-ÿñÑ0-9_-]*\"*"
DEFAULT_SEPARATOR = "|"

# Artifact extensions that may be launched as analysis scripts.
SCRIPT_EXTENSIONS = ("py", "r", "qmd")


def listed_path(encoded: Column) -> Column:
    """A path of a scan's metadata, which is percent-encoded, as a listing prints it."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def scanned_path() -> Column:
    """The path of the file that a scanned row comes from, as a listing prints it."""
    return listed_path(F.col("_metadata.file_path"))


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, ANSI_CODE, "")


def first_line(text: Column) -> Column:
    """Text up to the first line break, trailing whitespace removed."""
    return F.rtrim(F.split_part(text, F.lit("\n"), F.lit(1)))


def infer_separator(header: Column) -> Column:
    """First character left after removing name runs; ``|`` when none."""
    left = F.regexp_replace(header, NAME_RUN, "")
    return F.when(F.length(left) > 0, F.substring(left, 1, 1)).otherwise(F.lit(DEFAULT_SEPARATOR))


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def underscore_spaces(name: Column) -> Column:
    return F.regexp_replace(name, " ", "_")


def artifact_category(rel_path: Column, name: Column) -> Column:
    """logs / dqa / analysis by path and name, first match wins."""
    low = F.lower(name)
    return (F.when(rel_path.contains("logs"), F.lit("logs"))
            .when(rel_path.contains("dqa") | low.contains("validator"), F.lit("dqa"))
            .when(low.endswith(".log") | low.endswith(".txt"), F.lit("logs"))
            .otherwise(F.lit("analysis")))


def script_extension(name: Column) -> Column:
    """The part after the first dot, lower case (``a.tar.py`` gives ``tar``)."""
    return F.lower(F.split_part(name, F.lit("."), F.lit(2)))


def is_script(name: Column) -> Column:
    return script_extension(name).isin(*SCRIPT_EXTENSIONS)


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
