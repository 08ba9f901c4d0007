"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows of ``WINDOW`` characters, half overlapping.
If a window of m characters lies in a document with at most k edits, the two
share at least m - q + 1 - kq q-grams, and their diagonals (place in the
document minus place in the item) stay within k of one another.  Shared q-grams
are counted in overlapping bands of 2(k + 1) diagonals, so every such region is
whole in one band; regions that reach the bound are verified by banded
alignment.  A document is contaminated by an item when one of the item's windows
is verified.

Texts are compared lower-cased with white space runs as one space; spans are given
in the original text.  Items shorter than ``SHORTEST`` characters leave no room
for the lemma: they are found where they stand exactly and between word boundaries.
Items below ``LEAST`` characters, a word or two, are no evidence and are not searched.

Windows with the same text are one window that several items hold.  The occurrences of
the shared q-grams are expanded ``_ROWS`` at a time (slices of the text that overlap
by more than a region), so q-grams of many windows, a common lead-in, cost time and
no memory; alignments give up as soon as the budget is spent, from the end of
the window that fewer windows share.

The benchmark is the query set and is held in blocks of at most about
``BLOCK_CHARS`` characters.  Each block is one pass over the documents, without a
shuffle; with several blocks each pass is written before the next block is read, so
the driver holds one block.  A document is scanned whole.

Defined results: null and empty texts and items match nothing; repeated documents
and items give a row each for distinct ids; a null item_id or doc_id is kept as
null; an empty benchmark finds nothing; other columns pass through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import write_read
from tessera.llm.shingles import mix

Q = 10
WINDOW = 80
EDIT_RATE = 0.08
SHORTEST = 32        # below it an item is searched exactly,
LEAST = 8            # and below this one, a word or two, not at all
BLOCK_CHARS = 4_000_000
_CHUNK = 500_000     # characters scanned at a time
_VERIFY = 4096         # alignments run together
_ROWS = 2_000_000      # occurrences of q-grams in windows that are expanded together
_LOOK = 8              # characters aligned before hopeless alignments are dropped
_BITS = 22
_STOP = 0x110000       # between texts; no character has this value
_TABLE = 0x3001
_BASE = 0x9E3779B97F4A7C15
# fixed values: Unicode white space
_SPACES = np.zeros(_TABLE + 1, bool)
_SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
         0x3000]] = True

FOUND = "doc_id long, item_id long, start long, end long, windows long, edits long"


def normal(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters and the original place of each."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    low = text.lower()
    if len(low) != len(text):    # a few letters grow when lower-cased; they stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACES[np.minimum(code, _TABLE)]
    keep = ~space
    keep[1:] |= ~space[:-1]       # the first of a run of spaces stays
    if space[0]:
        keep[0] = False
    at = np.flatnonzero(keep)
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return np.where(space[at], np.uint32(32), code[at]).astype(np.uint32), at


def gram_hashes(code: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place on (by doubling)."""
    if len(code) < Q:
        return np.empty(0, np.uint64)
    h, size = mix(code.astype(np.uint64), 21), 1
    powers, out, done = [(1, h)], None, 0
    while 2 * size <= Q:
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
        powers.append((size, h))
    for size, h in reversed(powers):
        if done + size <= Q:
            if out is None:
                out = h
            else:
                n = len(code) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + h[done:done + n]
            done += size
    return mix(out[:len(code) - Q + 1])


@dataclass
class Index:
    items: list          # item ids
    codes: np.ndarray    # all items' characters, one after another
    window_items: list         # items (places in ``items``) of each window
    backwards: np.ndarray      # windows whose end is rarer than their beginning
    window_start: np.ndarray   # in codes
    window_size: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray          # sorted distinct hashes
    first: np.ndarray          # occurrences of each: slice of window, place
    window: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    short: dict          # size -> hashes, and items by text, of items below SHORTEST


def build(items: list[tuple]) -> Index:
    """Index of (item_id, text) rows."""
    ids, parts, w_start, w_size = [], [], [], []
    held: dict[bytes, list] = {}       # windows by their text, in order of appearance
    short: dict[str, list] = {}
    at = 0
    for item, text in items:
        code, _ = normal(text)
        if len(code) < LEAST:
            continue
        ids.append(item)
        if len(code) < SHORTEST:
            short.setdefault(code.tobytes().decode("utf-32-le", "surrogatepass"), []).append(len(ids) - 1)
            continue
        size = min(WINDOW, len(code))
        for s in sorted({*range(0, len(code) - size + 1, max(1, size // 2)), len(code) - size}):
            key = code[s:s + size].tobytes()
            if key not in held:
                held[key] = []
                w_start.append(at + s)
                w_size.append(size)
            if not held[key] or held[key][-1] != len(ids) - 1:
                held[key].append(len(ids) - 1)
        parts.append(code)
        at += len(code)
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    w_start, w_size = np.array(w_start, np.int64), np.array(w_size, np.int64)
    # the budget leaves a bound of one common q-gram at least
    budget = np.minimum((w_size * EDIT_RATE).astype(np.int64), (w_size - Q) // Q)
    hashes, windows, places = [np.empty(0, np.uint64)], [], []
    for w, (s, m) in enumerate(zip(w_start.tolist(), w_size.tolist())):
        h = gram_hashes(codes[s:s + m])
        hashes.append(h)
        windows.append(np.full(len(h), w))
        places.append(np.arange(len(h)))
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[grams >> np.uint64(64 - _BITS)] = True
    first = np.append(first, len(flat))
    empty = np.empty(0, np.int64)
    window, place = (np.concatenate(windows) if windows else empty), (np.concatenate(places) if places else empty)
    # how many windows hold a window's first and last q-gram
    often = np.empty(len(flat), np.int64)
    often[order] = np.repeat(np.diff(first), np.diff(first))
    ends = np.cumsum(w_size - Q + 1) if len(w_size) else empty
    backwards = often[ends - 1] < often[ends - (w_size - Q + 1)] if len(w_size) else np.zeros(0, bool)
    by_size: dict[int, dict] = {}
    for text, rows in short.items():
        by_size.setdefault(len(text), {})[text] = rows
    exact = {n: (np.unique([_piece_hash(normal(t)[0]) for t in texts]), texts) for n, texts in sorted(by_size.items())}
    return Index(ids, codes, list(held.values()), backwards, w_start, w_size, budget, w_size - Q + 1 - budget * Q, grams,
                 first, window[order], place[order], bitmap, exact)


def align(pattern: np.ndarray, region: np.ndarray, budget: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern inside its region, and the end of that alignment.

    (n, m) patterns and (n, m + band) regions; the alignment starts anywhere on the
    band's first ``band + 1`` places and stays inside the band.  With a budget, rows
    that must exceed it are given up on and have more edits than it.
    """
    n, m = pattern.shape
    width = region.shape[1] - m + 1
    edits, end = np.full(n, 1 << 20, np.int32), np.full(n, m)
    live = np.arange(n)
    cost = np.zeros((n, width), np.int32)
    far = np.full((n, 1), 1 << 20, np.int32)
    step = np.arange(width, dtype=np.int32)
    for i in range(m):
        new = cost + (region[:, i:i + width] != pattern[:, i:i + 1])
        np.minimum(new, np.concatenate([cost[:, 1:], far], axis=1) + 1, out=new)      # a pattern character left out
        cost = np.minimum.accumulate(new - step, axis=1) + step                       # region characters put in
        if budget is not None and i % _LOOK == _LOOK - 1:
            keep = cost.min(axis=1) <= budget
            if not keep.all():
                live, cost, far, region, pattern = live[keep], cost[keep], far[keep], region[keep], pattern[keep]
                if not len(live):
                    return edits, end
    best = cost.argmin(axis=1)
    edits[live], end[live] = cost[np.arange(len(live)), best], best + m
    return edits, end


def search(texts, index: Index) -> Iterator[tuple]:
    """(text number, item number, start, end, windows, edits) of every contaminated pair."""
    codes, maps, held, first = [], [], 0, 0
    for i, t in enumerate(texts):
        code, at = normal(t)
        codes.append(code)
        maps.append(at)
        held += len(code)
        if held > _CHUNK:
            yield from _search_chunk(codes, maps, index, first)
            codes, maps, held, first = [], [], 0, i + 1
    if codes:
        yield from _search_chunk(codes, maps, index, first)


def _slices(at: np.ndarray, k: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of the hits whose occurrences number about ``_ROWS``; each overlaps the next by more than a region."""
    total = np.concatenate([[0], np.cumsum(k)])
    a, reached = 0, 0
    while reached < len(at):
        z = min(max(int(np.searchsorted(total, total[a] + _ROWS, "right")) - 1, reached + 1), len(at))
        yield a, z
        a, reached = int(np.searchsorted(at, at[z - 1] - 3 * WINDOW)), z


def _regions(at: np.ndarray, place: np.ndarray, index: Index, span: int) -> np.ndarray:
    """Distinct (window, band) of the hits that reach the bound, as window * span + band."""
    # one row per occurrence of the q-gram in a window
    k = index.first[place + 1] - index.first[place]
    row = np.repeat(np.arange(len(at)), k)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    occurrence = index.first[place][row] + inside
    w = index.window[occurrence]
    diagonal = at[row] - index.place[occurrence] + WINDOW    # never below zero
    band = diagonal // (index.budget[w] + 1)
    # bands overlap: diagonals [b * half, (b + 2) * half) for every b
    regions, count = np.unique(np.concatenate([w * span + band, w * span + band - 1]), return_counts=True)
    return regions[count >= index.bound[regions // span]]


def _powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64."""
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def _piece_hash(code: np.ndarray) -> np.uint64:
    return np.uint64((mix(code.astype(np.uint64), 33) * _powers(len(code))).sum(dtype=np.uint64))


def _short_items(flat, starts, codes, maps, index) -> Iterator[tuple]:
    """Items below ``SHORTEST`` where they stand exactly and no word goes on: (text, item, start, end)."""
    if not index.short:
        return
    # hashes of all pieces of one length are differences of prefix sums, brought back to the first power
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat.astype(np.uint64), 33) * _powers(len(flat)))])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(flat) - 1, 0), pow(_BASE, -1, 1 << 64), np.uint64)]))
    for size, (hashes, items) in index.short.items():
        if len(flat) < size:
            continue
        h = (sums[size:] - sums[:-size]) * back[:len(flat) - size + 1]
        at = np.searchsorted(hashes, h)
        at[at == len(hashes)] = 0
        for i in np.flatnonzero(hashes[at] == h).tolist():
            d = int(np.searchsorted(starts, i, "right")) - 1
            lo, code = i - int(starts[d]), codes[d]
            text = code[max(lo - 1, 0):lo + size + 1].tobytes().decode("utf-32-le", "surrogatepass")
            piece = text[lo > 0:][:size]
            before, after = text[:1] if lo else "", text[(lo > 0) + size:]
            if piece in items and not (before.isalnum() and piece[0].isalnum()) and not (after.isalnum() and piece[-1].isalnum()):
                yield from ((d, item, int(maps[d][lo]), int(maps[d][lo + size - 1]) + 1) for item in items[piece])


def _search_chunk(codes, maps, index, first) -> Iterator[tuple]:
    found: dict[tuple, list] = {}

    def add(doc, items, span, window, edits):
        for item in items:
            f = found.setdefault((doc, item), [span[0], span[1], set(), edits])
            f[0], f[1], f[3] = min(f[0], span[0]), max(f[1], span[1]), min(f[3], edits)
            f[2].add(window)

    stop = np.array([_STOP], np.uint32)
    flat = np.concatenate([x for c in codes for x in (c, stop)])
    starts = np.cumsum([0] + [len(c) + 1 for c in codes])
    for d, item, lo, hi in _short_items(flat, starts, codes, maps, index):
        add(d, [item], (lo, hi), (lo, hi), 0)
    if len(index.grams):
        h = gram_hashes(flat)
        at = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        place = np.searchsorted(index.grams, h[at])
        place[place == len(index.grams)] = 0
        same = index.grams[place] == h[at]
        at, place = at[same], place[same]
        span = len(flat) + 2 * WINDOW
        for a, z in _slices(at, index.first[place + 1] - index.first[place]):
            regions = _regions(at[a:z], place[a:z], index, span)
            _verify(regions // span, regions % span, flat, starts, codes, maps, index, add)
    for (doc, item), (lo, hi, windows, edits) in sorted(found.items()):
        yield first + doc, item, lo, hi, len(windows), edits


def _verify(w, band, flat, starts, codes, maps, index, add) -> None:
    """Banded alignment of windows in their regions; ``add`` gets what stays within the budget."""
    for m in np.unique(index.window_size[w]).tolist():
        for turned in (False, True):
            mine = np.flatnonzero((index.window_size[w] == m) & (index.backwards[w] == turned))
            for a in range(0, len(mine), _VERIFY):
                part = mine[a:a + _VERIFY]
                ws = w[part]
                budget = int(index.budget[ws[0]])          # the same for windows of one size
                begin = band[part] * (budget + 1) - WINDOW - budget
                region = begin[:, None] + np.arange(m + 2 * budget + 2 * (budget + 1))
                outside = (region < 0) | (region >= len(flat))
                text = np.where(outside, _STOP, flat[np.clip(region, 0, len(flat) - 1)])
                pattern = index.codes[index.window_start[ws][:, None] + np.arange(m)]
                edits, end = (align(pattern[:, ::-1], text[:, ::-1], budget) if turned else align(pattern, text, budget))
                good = np.flatnonzero(edits <= budget)
                if turned and len(good):      # the end of the found places, from the beginning
                    edits[good], end[good] = align(pattern[good], text[good])
                for i in good.tolist():
                    stop_at = int(begin[i] + end[i])
                    doc = int(np.searchsorted(starts, max(stop_at - 1, 0), "right")) - 1
                    hi = min(stop_at - starts[doc], len(codes[doc]))
                    lo = max(hi - m, 0)
                    add(doc, index.window_items[ws[i]], (int(maps[doc][lo]), int(maps[doc][hi - 1]) + 1), int(ws[i]), int(edits[i]))


def _blocks(benchmark: DataFrame, id_col: str) -> Iterator[tuple[Index, bool]]:
    """Indexes of bounded parts of the benchmark, one at a time, and whether there are several."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), "text").where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_CHARS))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield build(sorted(((r["id"], r["text"]) for r in part.distinct().collect()),
                           key=lambda r: (r[0] is None, r[0] or 0, r[1]))), n > 1


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: the span covering its verified windows, and their least edits."""
    def scan(index: Index):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids = pdf["doc_id"].tolist()
                rows = [(None if pd.isna(ids[d]) else int(ids[d]), index.items[i], lo, hi, n, e)
                        for d, i, lo, hi, n, e in search(pdf["text"], index)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "windows", "edits"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})
        return run

    out = None
    for index, several in _blocks(benchmark, "item_id"):
        part = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(scan(index), FOUND)
        if several:
            part = write_read(part, "benchmark-found")
        out = part if out is None else out.unionAll(part)
    return out


def contaminated_column(index: Index, text: str = "text") -> Column:
    @F.pandas_udf("boolean")
    def contaminated(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            hit = np.zeros(len(s), bool)
            for d, *_ in search(s, index):
                hit[d] = True
            yield pd.Series(hit)
    return contaminated(F.col(text))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all columns stay."""
    for index, several in _blocks(benchmark, "item_id"):
        docs = docs.where(~contaminated_column(index))
        if several:
            docs = write_read(docs, "benchmark-kept")
    return docs
