"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; rests longer than
``max_piece`` are cut into near-equal pieces.  Inside a task, groups of rests
are split over k windows by the differencing method: each rest starts as a
partial partition with one filled bin, the two partial partitions with the
largest imbalance are merged with their bins in opposite order, until one is
left.  k starts at the least possible count and rises whenever the fullest
window exceeds the capacity, so no window overflows and none is cut by hand.

The groups are formed inside each input partition: a hot source, very long texts or
thousands of copies change nothing but the number of rests.  What is left of a partition
when no whole group is (below two groups) is not packed there: these rests of all partitions
are dealt out in turn, about ``SECOND_PIECES`` to a task, and packed in a second,
small round, so that the padding does not grow with the number of partitions.  A window
id is the partition number above ``_LOCAL_BITS`` bits of the window's number in that
partition, the second round's partitions following the first one's.

Defined results: a null or empty text is one piece holding END_ID; every id,
END_ID included, lies in exactly one piece; repeated rows are packed each;
a null doc_id stays null; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import write_read
from tessera.llm.tokenizing import default_vocab, encoder

CAPACITY = 2048
MAX_PIECE = 512       # a rest is cut so that a window holds at least four pieces
GROUP_PIECES = 512    # rests that are balanced together
SECOND_PIECES = 4096  # rests of a task of the second round, about
_LOCAL_BITS = 40
_SECOND = 1 << 22     # partition numbers of the second round begin here

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
DIGEST = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """k-way differencing of ``sizes``: bin sums and the item numbers of each bin."""
    n = len(sizes)
    if k == 1:
        return np.array([sizes.sum()]), [list(range(n))]
    # a partial partition: bin sums falling, and for each bin a node of the merge forest (-1: empty)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    parts, heap, made = {}, [], n
    for i, s in enumerate(sizes.tolist()):
        sums, node = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], node[0] = s, i
        parts[i] = (sums, node)
        heap.append((-s, i))
    heapq.heapify(heap)
    tag = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = parts.pop(a), parts.pop(b)
        sb, nb = sb[::-1], nb[::-1]
        sums, node = sa + sb, np.where(na < 0, nb, na)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        if len(both):
            ids = np.arange(made, made + len(both))
            left[ids], right[ids], node[both] = na[both], nb[both], ids
            made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        parts[tag] = (sums, node)
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), tag))
        tag += 1
    sums, node = parts[heap[0][1]]
    bins = []
    for top in node.tolist():
        items, stack = [], [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        bins.append(items)
    return sums, bins


def balance(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of item numbers, each within the capacity; the count rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sums, bins = difference(sizes, k)
        if sums.max() <= capacity:
            return [b for b in bins if b]
        k += 1


def cut(n: int, capacity: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: full windows, then pieces of the rest."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, at = n - full * capacity, full * capacity
    pieces = -(-rest // max_piece)
    for i in range(pieces):
        size = rest * (i + 1) // pieces - rest * i // pieces
        out.append((at, size))
        at += size
    return out


class _Packer:
    """Windows of one task: rows of pieces with window and offset."""

    def __init__(self, first: int, capacity: int):
        self.base, self.made, self.capacity = first << _LOCAL_BITS, 0, capacity

    def whole(self, piece: tuple) -> tuple:
        self.made += 1
        return (*piece, self.base + self.made - 1, 0)

    def group(self, rests: list[tuple]) -> Iterator[tuple]:
        """``rests``: (doc_id, start, length, ids, doc_tokens)."""
        for window in balance(np.array([r[2] for r in rests], np.int64), self.capacity):
            offset = 0
            for i in window:
                yield *rests[i], self.base + self.made, offset
                offset += rests[i][2]
            self.made += 1


_COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, group_pieces: int = GROUP_PIECES,
         vocab: str | None = None, digest: bool = False) -> DataFrame:
    """Pieces of all documents with the window they lie in.

    ``ids`` holds the piece as little-endian unsigned 32-bit ids; with
    ``digest`` its unsigned crc32 instead.  Windows are padded to ``capacity``
    by the reader.
    """
    payload = "ids_crc32" if digest else "ids"

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*_COLUMNS[:3], payload, *_COLUMNS[4:]])
        for c in ("doc_id", "sequence_id", "offset"):
            out[c] = out[c].astype("Int64")
        return out

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocab or default_vocab()).batch
        packer = _Packer(TaskContext.get().partitionId(), capacity)
        waiting: list[tuple] = []
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part, rows = pdf.iloc[at:at + 512], []
                for doc, ids in zip(part["doc_id"], encode(part["text"])):
                    doc = None if pd.isna(doc) else int(doc)
                    total = len(ids) // 4
                    for start, size in cut(total, capacity, max_piece):
                        piece = ids[4 * start:4 * (start + size)]
                        made = (doc, start, size, zlib.crc32(piece) if digest else piece, total)
                        if size == capacity:
                            rows.append(packer.whole(made))
                        else:
                            waiting.append(made)
                while len(waiting) >= 2 * group_pieces:
                    rows += packer.group(waiting[:group_pieces])
                    del waiting[:group_pieces]
                if rows:
                    yield frame(rows)
        if waiting:      # for the second round
            yield frame([(*r, None, None) for r in waiting])

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(_SECOND + TaskContext.get().partitionId(), capacity)
        waiting: list[tuple] = []
        for pdf in batches:
            ids = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
            waiting += zip(ids, pdf["start"].tolist(), pdf["length"].tolist(), pdf[payload].tolist(), pdf["doc_tokens"].tolist())
            while len(waiting) >= 2 * group_pieces:
                yield frame(list(packer.group(waiting[:group_pieces])))
                del waiting[:group_pieces]
        if waiting:
            yield frame(list(packer.group(waiting)))

    schema = DIGEST if digest else PIECES
    stored = write_read(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(first, schema), "packed")
    rests = stored.where("sequence_id IS NULL")
    tasks = -(-rests.count() // SECOND_PIECES)
    placed = stored.where("sequence_id IS NOT NULL")
    if not tasks:
        return placed
    # dealt in turn, so that copies spread; equal rows are equal pieces, whatever their order
    dealt = rests.repartition(tasks).sortWithinPartitions("doc_id", "start", "length", payload)
    return placed.unionAll(write_read(dealt.mapInPandas(second, schema), "packed-rests"))
