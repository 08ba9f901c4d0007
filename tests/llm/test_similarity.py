"""Jaccard components, near vectors and decontamination against brute force."""

from __future__ import annotations

import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from tessera.llm import decontaminate as D
from tessera.llm import jaccard as J
from tessera.llm import near_vectors as V
from tessera.llm.common import connected_components
from tessera.llm.shingles import shingle_sets


def closure(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_sets(rows):
    out = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def near_copy_rows(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.choice([3, 5, 8, 30, 60, 200]))] for _ in range(12)]
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        if rng.random() < 0.2:
            w = w + shared          # a long passage that many texts hold
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((i + 1, (" " if rng.random() < 0.8 else "\n").join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \t "), (903, "Üb é"), (904, "üb é"), (905, "Üb é"), (906, "x " * 30000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = near_copy_rows(seed)
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, component_id string, n long")
    sets = brute_sets(rows)
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = closure([r[0] for r in rows], links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(docs.repartition(5)).collect()}
    assert got == {r[0]: (len(s), want[r[0]]) for r, s in zip(rows, sets)}
    assert len(set(want.values())) < len(rows) - 20


def test_components_edge_cases(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text), (5, text), (3, text), (None, text), (8, "a b c d e f"), (8, "q w r t y u"), (4, "q w r t y u"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in J.components(docs).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (8, 4), (8, 4), (4, 4), (9, 9)], key=str)
    assert J.components(docs.limit(0)).collect() == []
    kept = [r.doc_id for r in J.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == [3, 4, 9, None]


def test_large_group_of_near_copies_and_of_a_common_passage(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(300):      # near copies: each changes two words of its own
        w = list(base)
        for k in rng.sample(range(120), 2):
            w[k] = f"u{i}_{k}"
        rows.append((i, " ".join(w)))
    for i in range(300, 600):  # unlike texts around one passage
        rows.append((i, " ".join(f"t{i}_{j}" for j in range(100)) + " " + passage))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.components(docs).collect()}
    sets = brute_sets(rows)
    links = [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert got == closure(range(600), links)


def test_shingle_sets_do_not_depend_on_their_neighbours():
    texts = [t for _, t in near_copy_rows(9)]
    together = [s.tolist() for s in shingle_sets(texts)]
    assert together == [next(shingle_sets([t])).tolist() for t in texts]
    assert [len(s) for s in together] == [len(s) for s in brute_sets([(0, t) for t in texts])]


def test_connected_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(60, 61), (61, 62), (62, 60)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    ids = {x for l in links for x in l if l[0] != l[1]}
    assert got == closure(ids, [l for l in links if l[0] != l[1]])


# ---- vectors ----
def vector_rows(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(20, dim))
    for i in range(400):
        v = centres[rng.integers(0, 20)] + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.06, 0.1, 0.15])
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], int(rng.integers(0, 3))))
    near = [0.98] + [0.0] * (dim - 2) + [float(np.sqrt(1 - 0.98**2))]
    rows += [(500, [1.0] + [0.0] * (dim - 1), 1), (501, near, 1), (502, [0.0] * dim, 1), (503, None, 1), (504, near, None),
             (505, [float("nan")] + near[1:], 1), (506, [None] + near[1:], 1), (507, [float("inf")] + near[1:], 1),
             (508, near[:3], 1), (509, near[:3], 1), (510, near, 1), (511, near, 1), (512, [], 1)]
    return rows


@pytest.mark.parametrize("tile", [32, 1024])
def test_vectors_equal_brute_force(spark, tile):
    rows = vector_rows(3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, kept int")

    def ok(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    links = []
    good = [r for r in rows if ok(r)]
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= 0.98:
                    links.append((a[0], b[0]))
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = closure(count, links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df, tile=tile).collect()}
    assert got == {i: (count[i], want[i], want[i] == i) for i in count}
    assert sum(count.values()) > 500


def test_vector_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert V.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [0.0, 1.0], 1),
                                (2, [0.0, 1.0], 1)], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 1, 1, False), (2, 1, 1, False), (None, 0, None, False), (1, 1, 1, True), (2, 1, 1, False)], key=str)


# ---- decontamination ----
def edit_distance_inside(pattern, text):
    prev = [0] * (len(text) + 1)
    for a in pattern:
        cur = [prev[0] + 1]
        for j, b in enumerate(text):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_decontamination_equals_brute_force():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    items = [(i, text(rng.choice([45, 50, 80, 95, 200]))) for i in range(8)]
    index = D.build(items)
    found = 0
    for _ in range(200):
        i, s = rng.choice(items)
        s = list(s)
        for _ in range(rng.randint(0, 8)):
            k, op = rng.randrange(len(s)), rng.random()
            if op < 0.4:
                s[k] = rng.choice("abcxyz")
            elif op < 0.7:
                s.insert(k, rng.choice("abcxyz"))
            elif len(s) > 5:
                del s[k]
        t = text(rng.randint(0, 150)) + "".join(s) + text(rng.randint(0, 150))
        plain = "".join(map(chr, D.normal(t)[0]))
        want = set()
        for w in range(len(index.window_items)):
            a = index.window_start[w]
            p = "".join(map(chr, index.codes[a:a + index.window_size[w]]))
            if edit_distance_inside(p, plain) <= index.budget[w]:
                want.update(index.items[i] for i in index.window_items[w])
        got = {index.items[x[1]] for x in D.search([t], index)}
        assert got == want, t
        found += len(want)
    assert found > 50


def test_short_items_and_shared_beginnings_equal_brute_force(monkeypatch):
    monkeypatch.setattr(D, "_ROWS", 500)          # many slices
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcde f") for _ in range(n))
    lead = "answer the following multiple choice question: "
    items = [(i, lead + text(rng.choice([10, 30, 60, 120]))) for i in range(60)]
    items += [(100 + i, text(rng.randint(8, 31)).strip().ljust(8, "b")) for i in range(40)] + [(200, lead + "x" * 40), (201, lead + "x" * 40)]
    index = D.build(items)
    assert sum(len(w) for w in index.window_items) > len(index.window_items)      # equal windows are one
    wanted = {i: "".join(map(chr, D.normal(t)[0])) for i, t in items}
    found = 0
    for _ in range(60):
        i, s = rng.choice(items)
        s = list(s)
        for _ in range(rng.choice([0, 0, 0, 2, 5, 8])):
            s[rng.randrange(len(s))] = rng.choice("abcxyz")
        t = text(rng.randint(0, 90)) + rng.choice([" ", "", ". "]) + "".join(s) + rng.choice([" ", "", "! "]) + text(rng.randint(0, 90))
        plain = "".join(map(chr, D.normal(t)[0]))
        want = set()
        for w in range(len(index.window_items)):
            a = index.window_start[w]
            p = "".join(map(chr, index.codes[a:a + index.window_size[w]]))
            if edit_distance_inside(p, plain) <= index.budget[w]:
                want.update(index.items[i] for i in index.window_items[w])
        for i, p in wanted.items():
            if D.LEAST <= len(p) < D.SHORTEST and re.search(
                    (r"(?<![a-z])" if p[0].isalnum() else "") + re.escape(p) + (r"(?![a-z])" if p[-1].isalnum() else ""), plain):
                want.add(i)
        assert {index.items[x[1]] for x in D.search([t], index)} == want, t
        found += len(want)
    assert found > 40


def test_a_common_beginning_of_many_items_costs_little():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    lead = "Answer the following multiple choice question: "
    index = D.build([(i, lead + " ".join(word() for _ in range(20))) for i in range(3000)])
    texts = [lead + " ".join(word() for _ in range(9)) for _ in range(40)]
    at = time.time()
    tracemalloc.start()
    assert list(D.search(texts, index)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - at < 20 and peak < 600e6, (time.time() - at, peak)


def test_decontamination_of_tables(spark):
    passage = "The quick brown fox jumps over the lazy dog while 42 cats watch from the old garden wall."
    other = "A wholly different question about the boiling point of water at sea level, in degrees?"
    bench = spark.createDataFrame([(1, passage), (2, other), (2, other), (3, None), (4, "short")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(10, "Intro. " + passage.upper().replace(" ", "\n  ") + " End.", "x"), (11, "nothing here", "x"), (12, None, "x"),
         (13, "", "x"), (14, "z" * 100000 + other.replace("boiling", "boilng") + passage, "x"), (None, passage, "x"),
         (15, "short " * 2000, "x")], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()}
    assert got == {(10, 1), (14, 1), (14, 2), (None, 1)}
    span = next(r for r in D.find(docs, bench).collect() if r.doc_id == 14 and r.item_id == 2)
    assert 100000 - 8 <= span.start <= 100008 and abs(span.end - (100000 + len(other) - 1)) <= 8
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [11, 12, 13, 15]
    assert D.find(docs.limit(0), bench).count() == 0 and D.find(docs, bench.limit(0)).count() == 0


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(12))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"lead {items[i % 40][1]} tail") for i in range(80)], "doc_id long, text string")
    whole = sorted(map(tuple, D.find(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    assert sorted(map(tuple, D.find(docs, bench).collect())) == whole and len(whole) == 80
