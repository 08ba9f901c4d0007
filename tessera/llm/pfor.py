"""Token ids in binary files of patched frame-of-reference blocks.

File layout (little endian), one file per range partition of doc_id:

    magic                      8 bytes
    block 0, block 1, ...      each: n u32, minimum u32, width u8, exceptions u16,
                               n values of `width` bits packed without gaps,
                               exception positions u16[], exception values u32[]
    index: block starts        u64[blocks]
           doc_id i64[docs], doc_id is null u8[docs], ids of each document u64[docs]
    tail:  index start u64, blocks u64, docs u64, ids u64, magic

A block holds up to ``BLOCK`` ids, its minimum is subtracted, and the width is
the bits of the ``PERCENTILE`` largest remainder; larger ones are exceptions and
keep zero in their packed place.

Files are written by the tasks through pyarrow's filesystems into the shared
folder, each attempt under a name of its own; only the files named by the
stored manifest (one row per file) belong to the result, so a retried task
leaves at most an unused file.

Defined results: a null or empty text holds END_ID only; repeated ids keep all
rows; null ids come first; an empty table gives an empty manifest and no rows; other
columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import partition_starts, partitions, write_read
from tessera.llm.tokenizing import default_vocab, encoder
from tessera.session import scratch_path

MAGIC = b"TSPFOR01"
BLOCK = 8192
PERCENTILE = 95
_HEAD, _TAIL = struct.Struct("<IIBH"), struct.Struct("<QQQQ8s")

MANIFEST = "part int, path string, docs long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    k = max(0, -(-len(rest) * PERCENTILE // 100) - 1)
    width = int(np.partition(rest, k)[k]).bit_length()
    at = np.flatnonzero(rest >= (1 << width)) if width < 32 else np.empty(0, np.int64)
    outliers = rest[at].astype("<u4")
    rest[at] = 0
    # values in place fit the width, so two bytes of each are enough for a width of 16 at most
    cell = rest.astype("<u2") if width <= 16 else rest
    bits = np.unpackbits(cell.view(np.uint8).reshape(-1, cell.itemsize), axis=1, bitorder="little")[:, :width]
    return (_HEAD.pack(len(ids), low, width, len(at)) + np.packbits(bits.ravel(), bitorder="little").tobytes()
            + at.astype("<u2").tobytes() + outliers.tobytes())


def decode_block(buf: memoryview, at: int = 0) -> np.ndarray:
    n, low, width, k = _HEAD.unpack_from(buf, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    whole = 16 if width <= 16 else 32
    bits = np.zeros((n, whole), np.uint8)
    packed = np.frombuffer(buf, np.uint8, size, at)
    bits[:, :width] = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
    out = np.packbits(bits.ravel(), bitorder="little").view(f"<u{whole // 8}").astype("<u4")
    at += size
    out[np.frombuffer(buf, "<u2", k, at)] = np.frombuffer(buf, "<u4", k, at + 2 * k)
    return out + np.uint32(low)


class Writer:
    """Append documents; full blocks go to ``sink`` at once."""

    def __init__(self, sink):
        self._sink, self._rest, self._held = sink, [], 0
        self._starts, self._docs, self._sizes = [], [], []
        self._at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._sizes.append(len(ids) // 4)
        self._rest.append(ids)
        self._held += len(ids) // 4
        if self._held >= 64 * BLOCK:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self._rest), "<u4")
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            block = encode_block(ids[i:min(i + BLOCK, end)])
            self._starts.append(self._at)
            self._at += len(block)
            self._sink.write(block)
        self._rest, self._held = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> tuple[int, int]:
        self._blocks(last=True)
        index, total = self._at, sum(self._sizes)
        null = np.array([d is None for d in self._docs], np.uint8)
        self._sink.write(np.array(self._starts, "<u8").tobytes()
                         + np.array([0 if d is None else d for d in self._docs], "<i8").tobytes()
                         + null.tobytes() + np.array(self._sizes, "<u8").tobytes()
                         + _TAIL.pack(index, len(self._starts), len(self._docs), total, MAGIC))
        return len(self._docs), total


class Reader:
    """Index of one file, and its ids by block; ``source`` is a seekable file."""

    def __init__(self, source):
        self._f = source
        size = source.seek(0, 2)
        source.seek(size - _TAIL.size)
        index, blocks, docs, self.ids, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a block file, or cut short")
        source.seek(index)
        raw = source.read(size - _TAIL.size - index)
        self.block_starts = np.frombuffer(raw, "<u8", blocks, 0)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.null_ids = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
        self._ends = np.append(self.block_starts[1:], np.uint64(index)).astype(np.int64) if blocks else np.empty(0, np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first .. last-1, one read."""
        a = int(self.block_starts[first])
        self._f.seek(a)
        buf = memoryview(self._f.read(int(self._ends[last - 1]) - a))
        return np.concatenate([decode_block(buf, int(self.block_starts[i]) - a) for i in range(first, last)])

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document: only the blocks that hold it are read."""
        start = int(self.sizes[:i].sum())
        n = int(self.sizes[i])
        first, last = start // BLOCK, -(-(start + n) // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK:][:n]

    def documents(self) -> Iterator[tuple]:
        """(doc_id or None, ids as bytes) of all documents, a bounded number of blocks at a time."""
        held, nxt, count = [], 0, 0
        have = 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.null_ids.tolist(), self.sizes.tolist()):
            while have < n:
                last = min(nxt + 64, len(self.block_starts))
                got = self.blocks(nxt, last)
                nxt = last
                held.append(got)
                have += len(got)
            flat = held[0] if len(held) == 1 else np.concatenate(held)
            yield (None if null else doc), flat[:n].tobytes()
            held, have, count = [flat[n:]], have - n, count + 1


def _open(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = "file://" + "/" + path[len("file:"):].lstrip("/")
    elif path.startswith("/"):
        path = "file://" + path
    return fs.FileSystem.from_uri(path)


def write_ids(docs: DataFrame, folder: str | None = None, vocab: str | None = None) -> DataFrame:
    """Write all texts' ids in ascending doc_id order; returns the stored manifest.

    The manifest has one row per file: part (rising with doc_id), path, docs,
    ids.  ``folder`` must be storage all executors share; it defaults to a
    fresh folder below spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "pfor")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        for pdf in batches:
            if writer is None:
                encode, part = encoder(vocab or default_vocab()).batch, TaskContext.get().partitionId()
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.pfor"
                files, path = _open(name)
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = files.open_output_stream(path)
                writer = Writer(sink)
            for at in range(0, len(pdf), 512):
                chunk = pdf.iloc[at:at + 512]
                for doc, ids in zip(chunk["doc_id"], encode(chunk["text"])):
                    writer.add(None if pd.isna(doc) else int(doc), ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            yield pd.DataFrame({"part": [part], "path": [name], "docs": [n_docs], "ids": [n_ids]})

    ranged = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
              .repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text"))
    return write_read(ranged.mapInPandas(write, MANIFEST), "pfor-manifest")


def read_ids(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before), n_tokens and ids (or their crc32)."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, start in zip(pdf["path"], pdf["_start"]):
                files, path = _open(name)
                with files.open_input_file(path) as f:
                    rows, size = [], 0
                    for doc, ids in Reader(f).documents():
                        n = len(ids) // 4
                        rows.append((doc, start, n, zlib.crc32(ids) if digest else ids))
                        start, size = start + n, size + (16 if digest else len(ids))
                        if size > 16_000_000:
                            yield frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    # one row per file: `partitions` rows at most are numbered and broadcast
    starts = partition_starts(manifest.select(F.col("part").alias("_part"), F.col("ids").alias("n")))
    placed = (manifest.join(F.broadcast(starts), F.col("part") == F.col("_part"))
              .select("part", "path", "_start").repartitionByRange(partitions(manifest.sparkSession), "part"))
    return placed.select("path", "_start").mapInPandas(read, DIGEST if digest else DOCUMENTS)
