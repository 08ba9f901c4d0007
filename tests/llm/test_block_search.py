"""Blocked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import block_search as B

DOCS = "doc_id long, text string, rank string, score double, item_id long"
ITEMS = "item_id long, text string, doc_id long"


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    length = [sum(c.values()) for _, c in held]
    n, total = sum(x > 0 for x in length), sum(length)
    df = Counter(t for _, c in held for t in c)
    want = {}
    for item, text in items:
        scores = []
        for (i, c), x in zip(held, length):
            s = 0
            for t in terms_of(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * x * n) // total)))
            if s > 0:
                scores.append((-s, i is None, i))
        for r, (s, _, i) in enumerate(sorted(scores, key=lambda v: (v[0], v[1], v[2] or 0))[:top], 1):
            want[item, r] = (i, -s)
    return want


def corpus(seed, n=400):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(30)]
    rare = ["Ünï%d" % i for i in range(200)]
    items = [(i, " ".join(rng.choices(common, k=8) + rng.choices(rare, k=6))) for i in range(12)]
    docs = []
    for i in range(n):
        w = rng.choices(common, k=rng.randint(1, 60)) + rng.choices(rare, k=rng.randint(0, 5))
        if rng.random() < 0.1:
            w += rng.choice(items)[1].split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper().replace("ÜNÏ", "Ünï")))
    return docs + [(5000 + i, docs[0][1]) for i in range(n // 2)], items      # a third of the rows are copies


def run(spark, docs, items, top=20, parts=4):
    d = spark.createDataFrame([(i, t, "x", 0.5, 3) for i, t in docs], DOCS).repartition(parts)
    got = B.rank(d, spark.createDataFrame([(i, t, 9) for i, t in items], ITEMS), top).collect()
    out = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert run(spark, docs, items) == brute(docs, items, 20)


def test_small_shards_and_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD_DOCS", 64)
    monkeypatch.setattr(B, "ITEM_BYTES", 300)
    monkeypatch.setattr(B, "BLOCK", 5)
    docs, items = corpus(3)
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_defined_results(spark):
    docs = [(None, "alpha beta"), (3, "alpha beta"), (2, "ALPHA, beta!"), (2, "alpha beta"), (9, None), (8, ""), (7, " ;;"),
            (6, "gamma " * 100_000), (5, "Éa éa"), (4, "x" * 200_000)]
    items = [(1, "Alpha"), (1, "Alpha"), (2, None), (3, ""), (4, "gamma gamma"), (5, "éa"), (None, "beta"), (6, "nowhere"), (7, ".")]
    got = run(spark, docs, items)
    assert got == brute(docs, [(1, "alpha"), (4, "gamma gamma"), (5, "éa"), (None, "beta")], 20)
    assert [v[0] for k, v in sorted(got.items(), key=str) if k[0] == 1] == [2, 2, 3, None]
    empty = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert B.rank(empty, some).collect() == []
    assert B.rank(spark.createDataFrame([(1, "a", "", 0.0, 1)], DOCS), some.limit(0)).collect() == []


def test_blocks_cover_the_lists_and_their_maxima_bound_every_score(monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 3)
    docs, items = corpus(4, 300)
    counts = [Counter(terms_of(t)) for _, t in items]
    counts = [Counter({k.encode(): v for k, v in c.items()}) for c in counts]
    terms = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    rows, df, total = [], np.zeros(len(terms), np.int64), 0
    for i, t in docs:
        c = Counter(w.encode() for w in terms_of(t))
        got = sorted((terms[w], k) for w, k in c.items() if w in terms)
        for a, _ in got:
            df[a] += 1
        total += sum(c.values())
        rows.append((i, sum(c.values()), np.array([a for a, _ in got], "<i4").tobytes(), np.array([k for _, k in got], "<i4").tobytes()))
    q = B.Items(counts, terms, df, len(docs))
    shard = B.Shard(rows, q, len(terms), (len(docs), total), np.random.default_rng(1).normal(size=(len(terms), 8)).astype(np.float32))
    several = 0
    for term in q.holders:
        listed, ends, columns, summary = shard.blocked(term)
        assert sorted(listed.tolist()) == np.flatnonzero(shard.impact[:, term]).tolist()
        several += len(summary) > 1
        for b in range(len(summary)):
            members = listed[ends[b]:ends[b + 1]]
            assert len(members) and (summary[b] == shard.impact[np.ix_(members, columns)].max(0)).all()
    assert several > 5
    for i in range(len(items)):
        shard.search(i, B.Best(5))
    assert shard.skipped > 0


def test_best_breaks_ties_by_id_and_keeps_rows_without_id_last():
    b = B.Best(3)
    b.add(np.array([5, 5, 5, 9]), np.array([4, 2, 0, 7]), np.array([False, False, True, False]))
    assert b.id.tolist() == [7, 2, 4] and b.threshold == 5
    b.add(np.array([5, 4]), np.array([1, 0]), np.array([False, False]))
    assert b.id.tolist() == [7, 1, 2]
