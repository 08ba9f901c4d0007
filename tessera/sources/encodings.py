"""The encoding of text files, scored from classes of bytes.

One aggregate over a scan of the raw lines counts, for each file, its bytes by class: NUL
bytes, bytes above ASCII that stand as letters and signs do in running text, the
bytes that only Windows-1252 defines, those that it leaves undefined, and the lines that
are valid UTF-8.  Each encoding gets a score between 0 and 1 from them; the best one is taken
if its score reaches ``CONFIDENCE``, else UTF-8 stands, as for files without evidence.

Bytes are looked at as Latin-1 characters, one a byte, so all of it runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import scanned_path

CONFIDENCE = 0.95
UTF8, UTF16LE, UTF16BE, CP1252, LATIN1 = "UTF-8", "UTF-16LE", "UTF-16BE", "windows-1252", "ISO-8859-1"

# The characters of Windows-1252 between 0x80 and 0x9F, in order; five bytes are undefined.
_CP1252 = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
_UNDEFINED = "\\u0081\\u008d\\u008f\\u0090\\u009d"
_C1 = "\\u0080-\\u009f"
_LETTER = "\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff"
_SIGN = "\\u00a0-\\u00bf\\u00d7\\u00f7"
_ASCII = "A-Za-z"
# a letter beside a letter, or alone between blanks; a sign beside a letter, a digit, a blank or a line's end
_LETTERS = (f"(?<=[{_ASCII}{_LETTER}{_C1}])[{_LETTER}]|[{_LETTER}](?=[{_ASCII}{_LETTER}{_C1}])"
            f"|(?<=^|[\\s\"'(,.;])[{_LETTER}](?=$|[\\s\"'),.;:])")
_SIGNS = f"(?<=^|[\\s{_ASCII}0-9{_LETTER}])[{_SIGN}]|[{_SIGN}](?=$|[\\s{_ASCII}0-9{_LETTER}])"


def _bytes(value: Column) -> Column:
    """A raw text value as Latin-1 characters, one a byte."""
    return F.decode(value.cast("binary"), "ISO-8859-1")


def byte_classes(lines: DataFrame) -> DataFrame:
    """``lines`` (file, block, value as read) -> counts of one file a row."""
    raw = lines.select("file", "value", _bytes(F.col("value")).alias("b"), (F.col("block") == 0).alias("lead"),
                       F.monotonically_increasing_id().alias("at"))
    count = lambda p: F.sum(F.regexp_count("b", F.lit(p)))
    above = F.col("b").rlike("[\\u0080-\\u00ff]")
    first = F.when(F.col("lead"), F.col("at"))
    return raw.groupBy("file").agg(
        F.sum(F.length("b") + 1).alias("bytes"), count("\\u0000").alias("nul"),
        F.count_if(above).alias("high_lines"), F.count_if(above & F.is_valid_utf8("value")).alias("utf8_lines"),
        count(f"[{_C1}]").alias("c1"), count(f"[{_UNDEFINED}]").alias("undefined"), count("[\\u00a0-\\u00ff]").alias("high"),
        count(_LETTERS).alias("letters"), count(_SIGNS).alias("signs"),
        F.min_by(F.substring("b", 1, 2), first).alias("mark"))


def encoding_scores(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``file, encoding, confidence, utf8, utf16, cp1252, latin1`` of every file with a line."""
    read = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    c = byte_classes(read.select(scanned_path().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    marked = F.col("mark").isin("\xff\xfe", "\xfe\xff")
    single = F.col("c1") + F.col("high")
    text_like = F.col("nul") * 20 < F.col("bytes")            # single bytes are no text among many NULs
    score = lambda part: F.when(text_like & (single > 0), F.least(F.lit(1.0), part / single)).otherwise(0.0)
    scored = c.select(
        "file", "mark",
        F.when(marked | ~text_like, 0.0).when(F.col("high_lines") == 0, 1.0).otherwise(F.col("utf8_lines") / F.col("high_lines")).alias("utf8"),
        F.when(marked, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("nul") / F.col("bytes"))).alias("utf16"),
        score(F.col("letters") + F.col("signs") + F.col("c1") - F.col("undefined")).alias("cp1252"),
        score(F.col("letters") + F.col("signs")).alias("latin1"))
    # the file's first character shows the order of its two bytes
    little = F.when(marked, F.col("mark") == "\xff\xfe").otherwise(~F.col("mark").startswith("\x00"))
    # in order of preference among equal scores
    ranked = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("place"), e.alias("encoding")) for i, (s, e) in enumerate(
        [(F.col("utf8"), F.lit(UTF8)), (F.col("utf16"), F.when(little, UTF16LE).otherwise(UTF16BE)), (F.col("latin1"), F.lit(LATIN1)),
         (F.col("cp1252"), F.lit(CP1252))])]))
    sure = ranked["score"] >= CONFIDENCE
    return scored.select("file", F.when(sure, ranked["encoding"]).otherwise(UTF8).alias("encoding"), ranked["score"].alias("confidence"),
                         "utf8", "utf16", "cp1252", "latin1")


def cp1252_text(latin1: Column) -> Column:
    """Text of a Windows-1252 file that was read as ISO-8859-1, which Spark's readers take."""
    return F.translate(latin1, "".join(chr(c) for c in range(0x80, 0xA0)), _CP1252)


def as_cp1252(text: Column) -> Column:
    """Text whose ISO-8859-1 bytes are its Windows-1252 bytes, for writing."""
    return F.translate(text, _CP1252, "".join(chr(c) for c in range(0x80, 0xA0)))
