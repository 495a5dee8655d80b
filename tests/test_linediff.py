"""Line scripts against brute force: they make the new text, and none is shorter."""

import random
from functools import lru_cache

from pyspark.sql import functions as F

from sievelake.operators import linediff, search


def replay(old, told):
    lines, out, at = (old.split("\n") if old is not None else []), [], 0
    for h in told:
        out += lines[at : h["old_line"] - 1]
        assert len(out) == h["new_line"] - 1
        out += h["lines"]
        at = h["old_line"] - 1 + h["n_old"]
    return out + lines[at:]


def longest(a, b):
    @lru_cache(None)
    def of(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + of(i + 1, j + 1) if a[i] == b[j] else max(of(i + 1, j), of(i, j + 1))

    return of(0, 0)


def test_scripts_are_shortest():
    rng = random.Random(1)
    for _ in range(1_500):
        a, b = ([rng.choice("abcd")[: rng.randint(0, 1)] for _ in range(rng.randint(0, 9))] for _ in range(2))
        kept = linediff.kept_lines(a, b)
        assert all(a[i] == b[j] for i, j in kept) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:], strict=False))
        assert len(kept) == longest(tuple(a), tuple(b))
        old, new = ("\n".join(s) if s else None for s in (a, b))
        assert replay(old, linediff.hunks(old, new)) == b
    assert linediff.hunks("", None) == [{"old_line": 1, "n_old": 1, "new_line": 1, "lines": []}] and linediff.hunks(None, None) == []


def test_long_texts():
    """Beyond LEAST lines: unique lines are anchors, and the script still makes the new text."""
    rng = random.Random(2)
    a = [f"line {k}" if k % 3 else "again" for k in range(6_000)]
    b = [x for x in a if rng.random() > 0.05]
    for k in range(0, 6_000, 400):
        b.insert(rng.randint(0, len(b)), f"new {k}")
    kept = linediff.kept_lines(a, b)
    assert all(a[i] == b[j] for i, j in kept) and len(kept) > 0.97 * (len(b) - 15)
    assert replay("\n".join(a), linediff.hunks("\n".join(a), "\n".join(b))) == b
    assert linediff.kept_lines(["x", "y"] * 2_000, ["p", "q"] * 2_000) == []


def test_tables(spark):
    rng = random.Random(3)
    lines = ["def go(a=1):", "x = 1", "# y = 2", "", "pass", "z: int", " def inner(): "]
    texts = [None if k == 5 else "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for k in range(40)]
    pairs = [(k, rng.choice(texts), rng.choice(texts), 1) for k in range(60)] + [(60, "a", "a", 1), (61, None, "x = 1", 1), (62, "x = 1", None, 1)]
    df = spark.createDataFrame(pairs, "file long, old string, new string, pos int")
    scripts = linediff.line_script(df)
    assert scripts.columns == ["file", "pos", "hunks"]
    made = {r.file: r.text for r in linediff.replayed(df.select("file", F.col("old").alias("text")), scripts, "file").collect()}
    assert made == {k: new for k, _, new, _ in pairs}

    def index(side):
        rows = df.select("file", F.posexplode(F.split(side, "\n", -1)).alias("at", "line"))
        return search.postings(rows.select("file", (F.col("at") + 1).alias("line_no"), "line"))

    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    assert rows(linediff.updated_postings(index("old"), scripts.drop("pos"))) == rows(index("new"))
    assert linediff.line_script(df.limit(0)).count() == 0


def test_changed_definitions(spark):
    df = spark.createDataFrame([("f", "a\nb\nc\nd\ne\nf", "a\nX\nc\nd\nf")], "file string, old string, new string")
    blocks = spark.createDataFrame([("f", 1, 1), ("f", 2, 3), ("f", 4, 4), ("f", 5, 5), ("g", 1, 9)], "file string, line_start int, line_end int")
    found = linediff.changed_definitions(blocks, linediff.line_script(df))
    assert sorted((r.line_start, r.line_end) for r in found.collect()) == [(2, 3), (5, 5)]
