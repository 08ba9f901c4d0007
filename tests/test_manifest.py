"""Digests fed line by line, and manifests that read only what changed."""

import gzip
import hashlib
import os
import random

import pytest

from tessera.sources import files as FS
from tests.test_load_and_publish import write

BOM = b"\xef\xbb\xbf"


def contents():
    rng = random.Random(3)
    return {"a.txt": b"one line", "b.txt": b"one line\n", "c.txt": b"\n", "d.txt": b"\n\nx\n\n", "e.txt": BOM + b"marked\nfile\n",
            "f.txt": BOM + b"no break", "g.bin": bytes(rng.randrange(256) for _ in range(300_000)), "h.txt": b"cr\r\nlf\r\n",
            "i.txt": b"", "j.txt.gz": gzip.compress(b"packed\nlines\n"), "k space.txt": b"x\ny", "l.txt": BOM + b"\n",
            "m.txt": b"0123456789abcdef\n" * 200_000}


@pytest.mark.parametrize("split", [4096, 1 << 27])
def test_digests_of_all_kinds_of_files(spark, workdir, split):
    files = contents()
    for n, data in files.items():
        write(os.path.join(workdir, "deep"), n, data)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        got = {r["path"]: (r["sha256"], r["size"], r["status"]) for r in FS.manifest(spark, workdir).collect()}
        assert spark.conf.get(key) == str(split)
    finally:
        spark.conf.set(key, before)
    assert got == {f"deep/{n}": (hashlib.sha256(d).hexdigest(), len(d), "new") for n, d in files.items()}


def test_only_changed_files_are_read_again(spark, workdir, monkeypatch):
    for n in "abc":
        write(workdir, f"{n}.txt", f"text {n}\n")
    first = FS.manifest(spark, workdir)
    assert {r["status"] for r in first.collect()} == {"new"}
    write(workdir, "b.txt", "longer text b\n")
    write(workdir, "d.txt", "text d\n")
    stamp = os.path.getmtime(os.path.join(workdir, "a.txt"))
    write(workdir, "a.txt", "TEXT a\n")          # same size, later
    os.utime(os.path.join(workdir, "a.txt"), (stamp + 60, stamp + 60))
    os.unlink(os.path.join(workdir, "c.txt"))
    read = []
    whole = FS.file_digests
    monkeypatch.setattr(FS, "file_digests", lambda s, p: read.extend(os.path.basename(x) for x in p) or whole(s, p))
    second = FS.manifest(spark, workdir, previous=first)
    got = {r["path"]: (r["status"], r["sha256"]) for r in second.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"a.txt": ("changed", sha("TEXT a\n")), "b.txt": ("changed", sha("longer text b\n")),
                   "c.txt": ("gone", sha("text c\n")), "d.txt": ("new", sha("text d\n"))}
    assert sorted(read) == ["a.txt", "b.txt", "d.txt"]
    read.clear()
    third = FS.manifest(spark, workdir, previous=second)
    assert {r["status"] for r in third.collect()} == {"same"} and third.count() == 3 and read == []
