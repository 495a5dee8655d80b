"""The trigram index against full scans, and exact percentiles of merged states against plain ones."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sievelake.functions.fixed_values import RULES
from sievelake.operators import metrics, search, trigrams


def test_ways():
    assert trigrams.ways("licen[sc]e|copy") == [frozenset({"lic", "ice", "cen"}), frozenset({"cop", "opy"})]
    assert trigrams.ways("ab(cde|fgh)+x?IJK") == [frozenset({"cde", "ijk"}), frozenset({"fgh", "ijk"})]
    assert trigrams.ways("a.c") == trigrams.ways("(abc)?") == trigrams.ways("(") == [frozenset()]
    many = trigrams.ways("".join(f"(?:aa{c}|bb{c})" for c in "cdefghij") + "tail")
    assert len(many) <= trigrams.WAYS and all({"tai", "ail"} <= w for w in many)


def test_search(spark):
    rng = random.Random(3)
    words = ["License", "copyright", "eval(x)", "md5(", "", "\n", "verify=False", "\u212aelvin perm", "password = 'abcdefghijklmnop'", "é", "ab", "PERMISSION"]
    texts = [(k, None if k == 3 else "".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for k in range(120)]
    df = spark.createDataFrame([*texts, (7, "copyright")], "file long, text string")
    index = trigrams.trigram_index(df).persist()
    assert {(r.trigram, r.file) for r in index.collect()} >= {("cop", 7), ("ght", 7)}
    patterns = ["licen[sc]e|copyright|permission", "kelvin", "a", "md5\\(", "no such thing", r"(?:verify\s*=\s*False)", "(eval|exec)\\(", *[r[-1] for r in RULES[:4]]]
    for pattern in patterns:
        lines = df.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("file", (F.col("pos") + 1).alias("line_no"), "line")
        rows = lambda frame: sorted(map(tuple, frame.collect()))
        assert rows(trigrams.search_indexed(index, df, pattern)) == rows(search.search_pattern(lines, pattern))
    found = trigrams.candidates(index, "copyright")
    assert {r.file for r in found.collect()} == {k for k, t in texts if t and re.search("copyright", t)} | {7}
    assert trigrams.candidates(index, ".") is None and trigrams.trigram_index(df.limit(0)).count() == 0


def test_percentiles(spark):
    """Hot values, values on both sides of 0, nulls; days' states that are merged give what all values give."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=rng.randint(0, 24 * 60)), rng.choice([7.0, 0.0, None, rng.gauss(0, 50), rng.expovariate(1) * 1e6, -1e-300, 5e-324, 1e300])) for _ in range(4_000)]
    rows += [(datetime(2025, 3, 1), 3.5), (datetime(2025, 4, 1), None), (datetime(2025, 5, 1), float("inf")), (datetime(2025, 5, 1), 1.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    states = metrics.value_states(df.limit(0), "t", "v")
    for part in (df.filter("hour(t) < 7"), df.filter("hour(t) >= 7")):  # two parts of the same days
        states = states.unionByName(metrics.value_states(part, "t", "v"))
    for period in metrics.PERIODS:
        got = {r.period_start: (r.a, r.b, r.c, r.d) for r in metrics.exact_percentiles(df, "t", "v", period, {"a": 0.5, "b": 0.99, "c": 0.0, "d": 1.0}, states).collect()}
        by = {}
        for t, v in rows:
            if v is not None:
                day = t.date()
                by.setdefault({"daily": day, "weekly": day - timedelta(days=day.weekday()), "monthly": day.replace(day=1)}[period], []).append(v)
        assert got.keys() == by.keys()
        for k, values in by.items():
            if np.isfinite(values).all():
                assert np.allclose(got[k], np.percentile(values, [50, 99, 0, 100]), rtol=1e-12, atol=1e-12)
            else:
                assert got[k][0] == float("inf") and got[k][2:] == (1.0, float("inf"))
    reviews = df.filter("year(t) = 2024").toDF("created_at", "analysis_time_ms")
    told = [{r.period_start: tuple(r)[2:] for r in metrics.period_metrics(reviews, "weekly", buffer).collect()} for buffer in (10, 10_000)]
    assert told[0].keys() == told[1].keys() and all(np.allclose(told[0][k], told[1][k], rtol=1e-12, atol=1e-12) for k in told[0])
    assert metrics.period_metrics(spark.createDataFrame([], "created_at timestamp_ntz, analysis_time_ms double"), "daily").count() == 0
