"""Line differences: the shortest script from one text to another, and an index brought up to date from the lines that changed alone."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import postings

LEAST = 2_000  # lines of both sides, up to which a script is the shortest; longer ones are cut at anchors first
HUNK = "array<struct<old_line:int,n_old:int,new_line:int,lines:array<string>>>"


def _shortest(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, by furthest reaching paths of growing numbers of edits."""
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append({k: reach[k] for k in range(-d - 1, d + 2) if k in reach})
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return _walked_back(trace, n, m)
    return []


def _walked_back(trace: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(trace) - 1, -1, -1):
        before, k = trace[d], x - y
        last = k + 1 if k == -d or (k != d and before[k - 1] < before[k + 1]) else k - 1
        at = before[last]
        while x > max(at, 0) and y > max(at - last, 0) and (d == 0 or (x, y) != (at + (last < k), at - last + (last > k))):
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = at, at - last
    return out[::-1]


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of lines that stand once on each side, as many as come in one order."""
    once = lambda s: {x for x, n in Counter(s).items() if n == 1}
    both = once(a) & once(b)
    at = {x: k for k, x in enumerate(b) if x in both}
    tails, rows, back = [], [], {}
    for i, x in enumerate(a):
        if x in both:
            k = bisect_left(tails, at[x])
            back[i] = rows[k - 1] if k else None
            tails[k : k + 1], rows[k : k + 1] = [at[x]], [i]
    out, i = [], rows[-1] if rows else None
    while i is not None:
        out.append((i, at[a[i]]))
        i = back[i]
    return out[::-1]


def kept_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (old, new) of the lines that stay, in order.

    They are as many as can be while both sides, without what they share at their ends, have LEAST lines together. Beyond that lines that are unique
    on both sides are kept first and the rest is told between them; a stretch without any is replaced whole.
    """
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if n - i + m - j <= LEAST:
            out += [(i + x, j + y) for x, y in _shortest(a[i:n], b[j:m])]
            continue
        p, q = i, j
        anchors = [(i + x, j + y) for x, y in _anchors(a[i:n], b[j:m])]
        out += anchors
        for x, y in [*anchors, (n, m)] if anchors else []:
            work.append((p, x, q, y))
            p, q = x + 1, y + 1
    return sorted(out)


def hunks(old: str | None, new: str | None) -> list[dict]:
    """What to replace, from the first line on: old_line (from 1) and n_old lines by ``lines``, which begin at new_line; nothing for equal texts."""
    a, b = (s.split("\n") if s is not None else [] for s in (old, new))
    out, i, j = [], 0, 0
    for x, y in [*kept_lines(a, b), (len(a), len(b))]:
        if x > i or y > j:
            out.append({"old_line": i + 1, "n_old": x - i, "new_line": j + 1, "lines": b[j:y]})
        i, j = x + 1, y + 1
    return out


def line_script(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` with hunks, the script from the text of ``old`` to that of ``new``, in place of both; null is a text without lines, an empty one has one.

    Every pair is told inside its row, without a shuffle. Lines end at newlines alone.
    """
    others = [c for c in pairs.columns if c not in (old, new)]
    kind = T._parse_datatype_string(HUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [hunks(a.as_py(), b.as_py()) for a, b in zip(batch.column(len(others)), batch.column(len(others) + 1), strict=True)]
            arrow = pa.list_(pa.struct([("old_line", pa.int32()), ("n_old", pa.int32()), ("new_line", pa.int32()), ("lines", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(told, arrow)], names=[*others, "hunks"])

    rows = pairs.select(*others, old, new)
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in others], T.StructField("hunks", kind)]))


def replayed(texts: DataFrame, scripts: DataFrame, *key: str) -> DataFrame:
    """key and text: what the ``scripts`` (key, hunks) make of the ``texts`` (key, text), one each; null where no line is left."""
    lines = F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>"))
    after = lambda h: h["old_line"] + h["n_old"]
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    between = lambda s, to: F.slice("_lines", s["at"], F.greatest(to - s["at"], F.lit(0)))
    step = lambda s, h: F.struct(after(h).alias("at"), F.concat(s["out"], between(s, h["old_line"]), h["lines"]).alias("out"))
    rows = texts.select(*key, lines.alias("_lines")).join(scripts.select(*key, "hunks"), [*key])
    made = F.aggregate("hunks", start, step, lambda s: F.concat(s["out"], between(s, F.size("_lines") + 1)))
    return rows.withColumn("_made", made).select(*key, F.when(F.size("_made") > 0, F.array_join("_made", "\n")).alias("text"))


def updated_postings(index: DataFrame, scripts: DataFrame) -> DataFrame:
    """``search.postings`` of the new texts, from the ``index`` of the old ones and ``scripts`` (file, hunks, one a file): only changed lines are read.

    Postings of lines that went away go, those of lines that stay move with them, and lines that came are indexed. Files without a script stay as they are.
    """
    hunks = F.coalesce("hunks", F.array().cast(HUNK))
    gone = F.exists("_hunks", lambda h: (F.col("line_no") >= h["old_line"]) & (F.col("line_no") < h["old_line"] + h["n_old"]))
    moved = F.aggregate("_hunks", F.lit(0), lambda s, h: s + F.when(h["old_line"] <= F.col("line_no"), F.size(h["lines"]) - h["n_old"]).otherwise(0))
    stay = index.join(scripts.select("file", "hunks"), "file", "left").withColumn("_hunks", hunks).filter(~gone).withColumn("line_no", (F.col("line_no") + moved).cast("int"))
    each = scripts.select("file", F.explode("hunks").alias("h")).select("file", "h.new_line", F.posexplode("h.lines").alias("pos", "line"))
    came = postings(each.select("file", (F.col("new_line") + F.col("pos")).alias("line_no"), "line"))
    return stay.select(*came.columns).unionByName(came)


def changed_definitions(definitions: DataFrame, scripts: DataFrame) -> DataFrame:
    """The ``definitions`` (file, line_start, line_end, any more) of new texts that hold a changed line, or the place of one that went: all to be read again."""
    first, last = F.col("line_start"), F.col("line_end")
    meets = F.exists("hunks", lambda h: (h["new_line"] <= last) & (h["new_line"] + F.greatest(F.size(h["lines"]), F.lit(1)) > first))
    return definitions.join(scripts.select("file", "hunks"), "file").filter(meets).select(*definitions.columns)


def successive(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """key, order, old and new: each text with the next of its key by ``order`` (the first with none before it is left out)."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, order, before.alias("old"), F.col(text).alias("new"), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("_n")).filter("_n > 1").drop("_n")
