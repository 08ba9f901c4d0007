"""License templates against regular expressions and every span."""

from __future__ import annotations

import random
import re
import time

import pytest

from tessera.llm import licenses as L
from tessera.llm.license_templates import TEMPLATES
from tessera.llm.words import words

DOCS = "doc_id long, text string, labels string, score int, n_words string"


def expression(nodes):
    """The language of a template as an expression over words that each end with a blank."""
    out = ""
    for n in nodes:
        if isinstance(n, bytes):
            out += re.escape(n.decode()) + " "
        elif n[0] == "any":
            out += r"(?:\S+ ){%d,%d}" % n[1:]
        elif n[0] == "optional":
            out += f"(?:{expression(n[1])})?"
        else:
            out += "(?:" + "|".join(expression(p) for p in n[1]) + ")"
    return out


def brute(markup, text):
    """First completing end, farthest beginning, no overlap; by trying every span."""
    exp = re.compile(expression(L.parse(markup)))
    found, past = [], 0
    for end in range(1, len(text) + 1):
        for start in range(past, end):
            if exp.fullmatch("".join(w.decode() + " " for w in text[start:end])):
                found.append((start, end))
                past = end
                break
    return found


ODD = ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d",
       "<<beginOptional>>a<<endOptional>> b <<var;name=x;words=0,3>> c <<var;name=y;match=a|b c|d>> a",
       "a <<var;name=x;words=2,4>> a <<beginOptional>>b<<endOptional>>",
       "<<var;name=x;match=a a|b>> c <<beginOptional>><<var;name=y;words=1,2>> d<<endOptional>> a",
       "a b <<var;name=x;match=c|c d>> <<beginOptional>>a <<var;name=y;match=b|d d>><<endOptional>> c"]


@pytest.mark.parametrize("markup", ODD)
def test_matches_equal_every_span(markup):
    rng = random.Random(7)
    t = L.Template("x", markup)
    hits = 0
    for _ in range(800):
        text = [rng.choice(b"a b c d".split()) for _ in range(rng.randint(0, 16))]
        assert t.matches(text) == brute(markup, text)
        hits += bool(t.matches(text))
        if t.matches(text):
            joined = b" " + b" ".join(text) + b" "
            assert all(any(p in joined for p in phrases) for phrases in t.needs)
    assert hits > 20


def render(nodes, rng):
    out = []
    for n in nodes:
        if isinstance(n, bytes):
            out.append(n)
        elif n[0] == "any":
            out += [b"zz%d" % rng.randint(0, 9) for _ in range(rng.randint(n[1], n[2]))]
        elif n[0] == "optional":
            out += render(n[1], rng) if rng.random() < 0.5 else []
        else:
            out += rng.choice(n[1])
    return out


@pytest.mark.parametrize("at", range(len(TEMPLATES)))
def test_every_template_takes_its_wording_and_no_other(at):
    rng = random.Random(at)
    label, markup = TEMPLATES[at]
    nodes = L.parse(markup)
    scanner = L.Scanner([TEMPLATES[at]], [])
    for _ in range(12):
        text = render(nodes, rng)
        around = [b"before"] * rng.randint(0, 3), [b"after"] * rng.randint(0, 3)
        n, _, found, score = scanner.scan(b"\n".join(around[0] + text + around[1]).upper())
        assert len(found) == 1 and found[0][2] == label and found[0][0] <= len(around[0]) and 0 < score <= 1
        fixed = [w for w in nodes if isinstance(w, bytes)]
        broken = list(text)
        lost = rng.choice([i for i, w in enumerate(broken) if broken.count(w) == 1 and fixed.count(w) == 1])
        broken[lost] += b"x"          # one mandatory word is spelt otherwise
        assert scanner.scan(b" ".join(broken))[2] == []


def test_unknown_markup_is_an_error():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", "a <<var;name=x>>", "a <<other;words=1,2>>"):
        with pytest.raises(ValueError):
            L.parse(bad)
    with pytest.raises(ValueError):
        L.Template("x", "<<beginOptional>>only this<<endOptional>>")


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for phrase, label in L.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
    return len(w), places


def test_query_over_rows(spark):
    rng = random.Random(3)
    bits = ["MIT", "License", "the", "Apache", "GENERAL", "Public", "license", "gpl", "Éa", "license x", "MIT-License", "x_y"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " .;"), (None, "MIT license"), (7, "MIT license"), (7, "MIT license"),
             (903, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
             (904, "Licensed under CC BY-NC 4.0."), (905, "general public license " * 30000)]
    df = spark.createDataFrame([(i, t, "q", 4, "z") for i, t in rows], DOCS).repartition(5)
    got = L.scan(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        n, places = plain(t)
        want = (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in by[i]]
        assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in by[i])
    assert by[903][0].labels == "apache,apache-2.0,gpl,gpl-3.0" and by[904][0].labels == "cc-by-nc-4.0" and by[904][0].score == 1.0
    assert by[901][0].labels == "" and by[901][0].score == 0.0 and by[900][0].n_words == 0
    assert L.scan(df.limit(0)).collect() == []


def test_time_is_linear_in_a_text_full_of_beginnings():
    start = TEMPLATES[0][1].split("deal in")[0]
    scanner = L.Scanner()
    scanner.scan(b"warm up")
    t = time.time()
    scanner.scan((start * 4000 + TEMPLATES[0][1]).encode())
    assert time.time() - t < 15
    assert len(words((start * 4000).encode())) > 90_000
