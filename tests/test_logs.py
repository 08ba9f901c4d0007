"""Log parsing without a window over a whole log."""

import random

import pytest

from tessera.operators import logs as L


def made_log(rng, n):
    out, entity = [], None
    want, errors = {}, []
    for _ in range(n):
        k = rng.random()
        if k < 0.05:
            entity = rng.choice("abcd")
            out.append(f'INFO:: Trying to load records in the table "{entity}"')
        elif k < 0.1:
            m = rng.randint(0, 3)
            out.append(f"INFO:: {m} records read.")
            if entity:
                want[entity] = ("success" if m else "fatal", m)
        elif k < 0.12:
            e = rng.choice("abcd")
            out.append(f'WARNING:: No file of the uploaded files matches the configuration of the "{e}" entity.!')
            want[e] = ("missing", 0)
        elif k < 0.15:
            errors.append([f"v{len(errors)}", None])
            out.append(f"ERROR:: Checking variable: {errors[-1][0]}")
        elif k < 0.2 and errors and errors[-1][1] is None:
            errors[-1][1] = rng.randint(1, 9)
            out.append(f"ERROR:: Found casting errors in {errors[-1][1]} line(s)")
        else:
            out.append("INFO:: \x1b[32mnothing\x1b[0m")
    return out, want, [(v, k) for v, k in errors if k]


@pytest.mark.parametrize("chunk", [3, 7, 10_000])
def test_logs_in_chunks_of_any_size(spark, chunk):
    rng = random.Random(chunk)
    rows, results, blocks = [], {}, {}
    for f, n in (("one", 400), ("two", 5), ("long", 900), ("empty", 0)):
        lines, results[f], blocks[f] = made_log(rng, n)
        rows += [(f, i + 1, t) for i, t in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, line long, text string").repartition(5)
    got = {}
    for r in L.load_results(df, chunk).collect():
        got.setdefault(r["file"], {})[r["entity"]] = (r["status"], r["total_records"])
    assert got == {f: w for f, w in results.items() if w}
    found = sorted((r["file"], r["variable"], r["affected_rows"]) for r in L.cast_errors(df, chunk).collect())
    assert found == sorted((f, v, k) for f, b in blocks.items() for v, k in b)


def test_no_window_holds_more_than_a_chunk(spark):
    df = spark.range(5000).selectExpr("'f' AS file", "id + 1 AS line", "'table \"x\"' AS text")
    plan = L.load_results(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_chunk" in plan.split("Window")[1].split("\n")[0]
