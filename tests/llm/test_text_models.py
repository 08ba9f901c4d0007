"""Page text, personal data, toxicity, language and the pipeline on small fixtures."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import html_text as H
from tessera.llm import langid as L
from tessera.llm import pii as P
from tessera.llm import toxicity as T
from tessera.llm.common import write_read
from tessera.session import scratch_root
from tests.conftest import SF_SMALL

PAGE = ('<!DOCTYPE html><html><head><title>Not this</title><style>p{{}}</style><script>var a="</p>";</script></head><body>'
        '<header>Site of things</header><nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">News page</a></li></ul></nav>'
        '<div class="ad">Buy this now and get one more for free today</div>{open}<h1>The &amp; title {n}</h1>'
        '<p>First  paragraph of the\n story &lt;{n}&gt; with <b>bold <i>words</b> here.<p>Second one &copy; 2024<br>goes on'
        '<div class="share-buttons">Share it</div><form><input name=q>Ask us<button>Go</button></form><!-- <p>no</p> -->'
        '<ul><li>point one<li>point two</ul>{close}<aside>Related things to read next</aside>'
        '<section id="comments"><p>I liked this story very much indeed thanks</p></section>'
        '<footer>All rights reserved</footer></body></html>')
TEXT = ("The & title {n}\nFirst paragraph of the story <{n}> with bold words here.\nSecond one © 2024 goes on\npoint one\npoint two")


def test_pages(spark):
    rows = [(i, f"u{i}", PAGE.format(n=i, open="<article>", close="</article>")) for i in range(30)]
    rows += [(100, "u", PAGE.format(n=100, open='<div class="post">', close="</div>")), (101, None, None), (102, "u", ""),
             (103, "u", "<p>&am &amp &quo;"), (104, "u", "<nav><a href=x>only a menu</a></nav>"), (100, "u", "plain words only"),
             (105, "u", "<article>cut off in a <b")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract_pages(df).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by = {(r.page_id, r.n_chars): r.text for r in got}
    texts = {r.page_id: r.text for r in got}
    for i in range(30):
        assert texts[i] == TEXT.format(n=i)
    assert (100, len(TEXT.format(n=100))) in by and by[100, len("plain words only")] == "plain words only"
    assert texts[101] == "" and texts[102] == "" and texts[104] == ""
    assert texts[103] == "&am & &quo;" and texts[105] == "cut off in a"
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract_pages(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<p>" * 100000 + "x", "<b>" * 30000 + "x" + "</i>" * 30000, "<div>" * 20000 + "x y" + "</div>" * 20000,
                                  "<a =\"" * 50000, "<" * 100000, "<!--" * 50000, "w " * 300000, "<script>" * 20000])
def test_odd_pages_take_linear_time(page):
    at = time.time()
    H.extract(page, {})
    assert time.time() - at < 10


# ---- personal data ----
def plain_base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and P.luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("0123456789 1.1.@+-()a.b5é") for _ in range(rng.randint(0, 60)))
        assert P.base_spans(t) == plain_base(t), t
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")


@pytest.mark.parametrize("text", ["1" * 200000, "a" * 200000, "1." * 100000, "+1" * 100000, "a@" * 100000, "1 " * 100000,
                                  "a1" * 100000 + "@", "a" * 200000 + "@b"])
def test_long_odd_texts_take_linear_time(text):
    model = P.Model(np.zeros(P._DIM), P.estimate({}))
    at = time.time()
    P.spans_of(text, model)
    assert time.time() - at < 5


_WORDS = "<h1>Title here</h1><p>" + "some words of the article that go on and on " * 6 + "</p><p>" + "a second paragraph " * 8 + "</p>"
_TEXT = "Title here\n" + ("some words of the article that go on and on " * 6).strip() + "\n" + ("a second paragraph " * 8).strip()


@pytest.mark.parametrize("page", [
    '<nav><a href=x>menu</a></nav><div class="content-sidebar-wrap">{}</div><footer>words at the foot</footer>',
    '<div class="post category-social">{}</div>', '<div class="post tag-ads">{}</div>',
    '<article class="post category-related">{}</article>', '<div class="discussion">{}</div>',
    '<article>{}</article><div class="replies"><article><p>a reader says a thing or two about it</p></article></div>',
    '<article>{}<section class="responses"><p>a reader says a thing</p></section></article>',
    '<article>{}<div id="comments"><article class="x"><p>a reader says a thing</p></article></div></article>',
    '<div class="layout"><div class="sidebar"><p>links and other things here</p></div>{}<div class="widget">more</div></div>',
    '<div class="sidebar-left"><div class="menu-page">{}</div></div>'])
def test_names_do_not_empty_a_page(page):
    assert H.extract(f"<body>{page.format(_WORDS)}</body>", {}) == _TEXT


def test_title_in_the_header_of_an_article():
    rest = "<p>" + "words of text " * 20 + "</p>"
    for head in ("<header><h1>Own title</h1><p>By someone</p></header>", '<div class="entry-header"><h1>Own title</h1><i>now</i></div>'):
        got = H.extract(f"<body><header><h1>Site</h1></header><article>{head}{rest}</article></body>", {})
        assert got == "Own title\n" + ("words of text " * 20).strip()


def test_region_has_the_greatest_sum():
    rng = random.Random(4)
    for _ in range(300):
        at = sorted(rng.sample(range(60), rng.randint(0, 25)))
        scored = [(i, rng.choice([-3, -1, -0.5, 0.5, 1, 2])) for i in at]
        total, first, last = H.best_region(scored)
        sums = {(a, b): sum(v for _, v in scored[a:b + 1]) for a in range(len(scored)) for b in range(a, len(scored))}
        assert total == max([0.0, *sums.values()])
        if last >= 0:
            assert total == sum(v for i, v in scored if first <= i <= last)


def test_learning_takes_its_share_of_labelled_pages(spark):
    pages = [(i, f"<body><article><p>{'inside ' * 30}{i}</p></article><p>out {i}</p></body>" if i % 50 == 0
              else f"<body><p>plain {i}</p></body>") for i in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    learned = H.fit(df, max_labelled=30)      # 60 of 3,000 pages are labelled: half of them are learned from
    assert learned["w|article|0|p"] > 1 and H.fit(df.where("page_id % 50 > 0"), max_labelled=30) == {}


def pii_rows():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        parts = ["Words of a text with nothing special in it, written in 1984 or so."]
        if i % 3 == 0:
            parts.append(f"Mail ana.{i}@mail{i % 9}.example.com or call +1 (555) 010-{1000 + i} from 10.0.{i}.7 now.")
        if i % 4 == 0:
            parts.append("password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)) + " is set.")
        if i % 5 == 0:
            parts.append("Paid by 4539 5787 6362 1486 at version 12.04 of the page 20240.")
        rows.append((i, " ".join(parts)))
    return rows


def test_personal_data(spark):
    rows = pii_rows() + [(900, None), (901, ""), (3, "twice 10.1.1.1"), (None, "no id 10.1.1.1")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n_email int")
    got = P.find(df).collect()
    assert len(got) == len(rows)
    texts = Counter((r[0], r[1]) for r in rows)
    assert len(texts) == len(rows)
    for r in got:
        mine = [t for d, t in texts if d == r.doc_id and (r.doc_id != 3 or (r.n_ip == 1) == ("twice" in t or "10.0." in t))]
        expect = [plain_base(t or "") for t in mine]
        assert any([r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in e) for k in P.KINDS]
                   and r.base_sha256 == hashlib.sha256(P._joined(e).encode()).hexdigest()
                   and r.spans.startswith(P._joined(e)) for e in expect)
    by = {r.doc_id: r for r in got}
    secrets = [i for i in range(120) if "secret" in by[i].spans]
    assert secrets == [i for i in range(120) if i % 4 == 0]
    assert all(by[i].spans == "" for i in range(120) if i % 3 and i % 4 and i % 5)
    out = {r.doc_id: r for r in P.redact(df).collect()}
    assert P.redact(df).columns == df.columns and out[900].text is None and out[901].text == ""
    assert "[EMAIL]" in out[0].text and "[PHONE]" in out[0].text and "[SECRET]" in out[0].text and "[CARD]" in out[0].text
    assert out[1].text == rows[1][1]
    assert P.find(df.limit(0)).collect() == []
    assert P.find(df.where("doc_id = 1")).collect()[0].spans == ""


@pytest.mark.parametrize("doc_id", [None, 7])
def test_personal_data_of_rows_that_share_an_id_or_have_none(spark, doc_id):
    df = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"),
                                    F.concat(F.lit("call 0049 171 "), F.col("id") % 900 + 1000, F.lit(" now")).alias("text"))
    got = P.find(df.repartition(6))
    assert got.count() == 20_000 and got.where("n_phone = 0").count() == 20_000
    same = df.select("doc_id", F.lit("token=ab12cd34ef56ab78cd90 and 10.1.2.3").alias("text"))
    assert P.find(same).where("spans LIKE 'ip:31:39%'").count() == 20_000
    least = P.fit(df.repartition(9), sample=50)
    assert len(least.weights) == P._DIM and np.isfinite(least.weights).all()


def test_sampled_candidates_stay_bounded_and_are_weighted():
    least = P.Least(3)
    for _ in range(5):
        for i in range(40):
            t = f"id {1000 + i} x"
            least.add(t, 3, 7, "-" * 8)
    assert len(least.seen) == 3 and least.full and {n for n, *_ in least.seen.values()} == {5}
    assert least.complete() == max(least.seen)


def test_many_addresses_in_one_text_take_linear_time():
    text = " ".join(f"a{i}@b{i % 977}.example.com 1234{i}" for i in range(100_000))
    model = P.Model(np.zeros(P._DIM), P.estimate({}))
    at = time.time()
    assert len(P.spans_of(text, model)) == 100_000
    assert time.time() - at < 40
    taken = P.Taken([("ip", 5, 9), ("card", 0, 20), ("phone", 30, 31)])
    for a in range(40):
        for b in range(a + 1, 41):
            assert taken.meets(a, b) == any(x < b and a < y for x, y in ((5, 9), (0, 20), (30, 31)))


def test_pipeline_leaves_only_its_result(spark):
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = corpus_pipeline.run(spark, SF_SMALL)
    after = set(os.listdir(root))
    assert got.count() > 0 and len(after - before) == 1 and (after - before).pop().startswith("pipeline-packing")


def test_filters_of_the_pipeline_on_odd_rows(spark):
    text = "a plain text of some words that nobody would mind and that stands here twice as it is"
    rows = [(None, text, "en", "s", 3), (None, text, "en", "s", 3), (7, None, "en", "s", None), (7, "", None, None, 0),
            (8, text, "en", "s", 1), (8, text + " or so", "en", "s", 1), (9, "word " * 50_000, "en", "s", 2)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, "
                                                                 "component_id string, score double")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_SMALL)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, text), (None, text), (7, ""), (8, text), (9, "word " * 50_000)], key=str)
    assert corpus_pipeline.drop_benchmark(spark, docs, SF_SMALL).count() == 7
    clean = corpus_pipeline.redact_personal_data(spark, docs, SF_SMALL)
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.select(*clean.columns).collect()))
    packed = corpus_pipeline.pack_windows(spark, docs, SF_SMALL)
    assert packed.where("doc_id IS NULL").count() == 2
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.drop_benchmark, corpus_pipeline.redact_personal_data,
                  corpus_pipeline.pack_windows):
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0


def test_overlapping_spans_are_redacted_once():
    model = P.Model(np.zeros(P._DIM), P.estimate({}))
    assert P.redacted("a +4539578763621486 b 4539578763621486@x.yz c", model).count("[") == 2


# ---- toxicity ----
def toxic_rows(n=600):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.choice([20, 60, 200]))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorkhead", "vilxyn", "quonk"])
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    bad = {i for i, t in rows if re.search("zorkhead|vilxyn|quonk", t)}
    extra = [(9000, None), (9001, ""), (9002, "!!! ... "), (3, "again"), (None, "no id zorkhead quonk vilxyn")]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(labels[0][0], None), labels[1], (None, 1)], "doc_id long, toxic int")
    got = T.score_documents(df, lab).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id in bad) for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9000].predicted == by[9001].predicted == by[9002].predicted == 0 and by[9000].score == by[9001].score
    kept = T.drop_toxic(df, lab)
    assert kept.columns == df.columns and {9000, 9001} <= {r.doc_id for r in kept.collect()}
    assert T.score_documents(df.limit(0), lab).collect() == []
    assert {r.score for r in T.score_documents(df, lab.limit(0)).collect()} == {0.0}


def test_held_out_rows_never_change_the_model(spark):
    rows, labels = toxic_rows(200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    lies = spark.createDataFrame([(i, t if i not in held else 1 - t) for i, t in labels], "doc_id long, toxic int")
    score = lambda lab: sorted((r.doc_id, r.score) for r in T.score_documents(df, lab).collect())
    assert score(told) == score(lies)


def test_nonnegative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    x = np.concatenate([(rng.random((4000, 3)) < np.where(y, 0.8, 0.02)[:, None]), rng.random((4000, 5)) < 0.3], axis=1)
    x = x.astype(np.float32)
    p, u = x[y][:300], x[1500:]
    w, b = T.nnpu(np.vstack([p, u]), np.arange(len(p) + len(u)) < len(p), 0.2)
    assert (((x @ w + b) > 0) == y).mean() > 0.95


def test_grams_stay_inside_words():
    texts = [b"Abcd, efgh", b"", b"abcdabcd"]
    seen = Counter(int(d) for doc, _ in T.grams(texts) for d in doc)
    assert seen[1] == 0 and seen[0] == 2 * (3 + 2 + 1)       # 4, 5 and 6 bytes of " abcd "
    alone = [sorted(zip(d.tolist(), f.tolist())) for _, _, d, f in T.presence([t.decode() for t in texts[:1]])]
    both = [sorted((a, f) for a, f in zip(d.tolist(), f.tolist()) if a == 0)
            for _, _, d, f in T.presence([t.decode() for t in texts])]
    assert alone == both


# ---- language ----
def test_language(spark):
    rng = random.Random(2)
    kinds = {"aa": ["ka", "lo", "mi", "tar"], "bb": ["sch", "ung", "ein", "pf"], "cc": ["é", "ção", "ñu", "ll"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(kinds))
        words = ["".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([4, 30, 400]))]
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None))
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 !? 4", "bb"), (903, "\U0001F600", None), (None, "kalo mi", "aa")]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(got[i], lang) for i, _, lang in rows if got[i].held_out and lang]
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.97 * len(held) and len(held) > 40
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(df.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 1000):
        data = bytes(range(1, 256)) * 4
        w, sizes = L.windows_of(data[:n])
        assert sizes.sum() == n and w.reshape(-1)[:n].tobytes() == data[:n]


def test_gradient_of_the_network_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = np.where(rng.random((60, L.WINDOW)) < 0.5, 97, 98).astype(np.uint8)
    y = np.arange(60) % 2
    for i in np.flatnonzero(y):
        x[i, 10:14] = [120, 121, 122, 120]
    net = L.train(x, y, ["p", "q"], epochs=12)
    assert (net.log_probabilities(x).argmax(1) == y).mean() > 0.95


# ---- the pipeline ----
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_read(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        before = docs
    original = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    left = docs.collect()
    assert 0.6 * len(original) < len(left) < len(original)
    squeeze = lambda t: " ".join((t or "").lower().split())
    assert not [r for r in left for b in bench if squeeze(b) in squeeze(original[r.doc_id])]
    assert not [r for r in left if plain_base(r.text)]
    pieces = corpus_pipeline.pack_windows(spark, docs, SF_SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in left}
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in E.queries()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = write_read(stage(spark, docs, SF_SMALL), f"test-empty-{name}")
        assert docs.count() == 0


def test_every_operator_is_registered():
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and len(names) == 10
