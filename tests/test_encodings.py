"""Encodings scored from byte classes."""

import os
import random

from pyspark.sql import functions as F

from tessera.sources import encodings as EN
from tests.test_load_and_publish import write


def test_encodings_of_files(spark, workdir):
    rng = random.Random(2)
    french = "L'été à Évian, où l'œuvre coûte 5 € « à peine » — naïve.\nDéjà vu, ça va.\n" * 40
    plain_french = "L'été à Évian, où l'hôte coûte « à peine » 5°.\nDéjà vu, ça va.\n" * 40
    files = {"ascii.txt": b"only plain words\n" * 30, "utf8.txt": french.encode(), "cp1252.txt": french.encode("cp1252"),
             "latin1.txt": plain_french.encode("latin-1"), "le.txt": "plain words\nand more\n".encode("utf-16-le") * 30,
             "be.txt": "plain words\nand more\n".encode("utf-16-be") * 30, "marked.txt": "süß\nx\n".encode("utf-16"),
             "marked_be.txt": b"\xfe\xff" + "süß\nx\n".encode("utf-16-be"), "junk.bin": bytes(rng.randrange(1, 256) for _ in range(20_000)),
             "mostly.txt": french.encode() * 10 + b"broken \xe9\n", "bom.txt": b"\xef\xbb\xbf" + french.encode(),
             "german.txt": ("Größe und Maß, über Öl; Ähre\n" * 20).encode("latin-1"), "spanish.txt": "¿Qué ó año? ¡Sí!\n".encode("latin-1") * 9}
    paths = [write(workdir, n, d) for n, d in files.items()]
    got = {os.path.basename(r["file"]): r for r in EN.encoding_scores(spark, paths).collect()}
    assert {n: r["encoding"] for n, r in got.items()} == {
        "ascii.txt": "UTF-8", "utf8.txt": "UTF-8", "cp1252.txt": "windows-1252", "latin1.txt": "ISO-8859-1", "le.txt": "UTF-16LE",
        "be.txt": "UTF-16BE", "marked.txt": "UTF-16LE", "marked_be.txt": "UTF-16BE", "junk.bin": "UTF-8", "mostly.txt": "UTF-8",
        "bom.txt": "UTF-8", "german.txt": "ISO-8859-1", "spanish.txt": "ISO-8859-1"}
    assert got["junk.bin"]["confidence"] < EN.CONFIDENCE <= min(r["confidence"] for n, r in got.items() if n != "junk.bin")


def test_windows_text_through_the_latin1_reader(spark, workdir):
    text = "œuvre “à” 5 € – ok…"
    path = write(workdir, "w.txt", text.encode("cp1252"))
    read = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01").select(EN.cp1252_text(F.col("_c0")).alias("t"))
    assert read.first()["t"] == text
    back = spark.createDataFrame([(text,)], "t string").select(F.encode(EN.as_cp1252(F.col("t")), "ISO-8859-1").alias("b")).first()["b"]
    assert bytes(back) == text.encode("cp1252")
