"""Line dedup, conversation repair and the filter audit, against brute force on small tables full of edge cases."""

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache
from itertools import permutations

from pyspark.sql import functions as F

from sievelake.llm import conversation_repair, filter_audit, line_dedup, queries

DOCS = "doc_id long, text string, lang string, source string, n_lines long, h string, mask int, part string"
SPACE = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    """Rows of (doc_id, text, lang); other columns clash with names that operators use."""
    return spark.createDataFrame([(d, t, lang, "s", 7, "x", 3, "p") for d, t, lang in rows], DOCS)


def lowered(key):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in key)


def lines_by_loop(texts, least):
    keys = [[lowered(line.strip(SPACE)) for line in (t or "").split("\n")] for t in texts]
    having = Counter(k for own in keys for k in set(own))
    for t, own in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own, strict=True) if not k or having[k] < least]
        yield len(lines), len(lines) - len(kept), "\n".join(kept)


def line_rows(seed=5):
    rng = random.Random(seed)
    parts = ["A shared line", " a SHARED line\t", "Other", "other ", "é", "É", "\x85", " x", "", "  ", "\r", "one of %d", "x" * 3_000]
    texts = ["\n".join(rng.choice(parts).replace("%d", str(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    return [*texts, None, "", "\n", "A shared line", *["copy\nof\nall"] * 30, "line\n" * 5_000]


def test_lines(spark):
    texts = line_rows()
    rows = [(None if k % 40 == 7 else k // 2, t, "en") for k, t in enumerate(texts)]
    for least, batches in ((10, 4), (2, 7), (10_000, 1)):
        got = line_dedup.drop_common_lines(documents(spark, rows), least=least, batches=batches)
        assert got.columns == [*(c for c in DOCS.replace(",", "").split()[::2] if c != "n_lines"), "n_lines", "n_dropped"]
        found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "", r.h, r["part"]) for r in got.collect())
        assert found == Counter((d, *told, "x", "p") for (d, _, _), told in zip(rows, lines_by_loop(texts, least), strict=True))
    report = line_dedup.line_report(documents(spark, rows)).collect()
    want = Counter((d, n, gone, hashlib.sha256(left.encode()).hexdigest()) for (d, _, _), (n, gone, left) in zip(rows, lines_by_loop(texts, 10), strict=True))
    assert Counter(map(tuple, report)) == want
    assert line_dedup.drop_common_lines(documents(spark, rows).limit(0)).count() == 0


def test_line_runs(spark):
    """Runs move up levels, stop counting at the limit, and know what is new; hot lines are joined as others are."""
    runs, rng, seen, total = line_dedup.LineRuns(spark, least=4, fan=2), random.Random(1), set(), Counter()
    assert runs.common().count() == 0
    for _ in range(6):
        batch = [bytes([rng.randint(0, 40)]) for _ in range(30)]
        keys = spark.createDataFrame([(b,) for b in batch], "h binary")
        assert {bytes(r.h) for r in runs.unseen(keys).collect()} == set(batch) - seen
        runs.add(keys)
        seen, total = seen | set(batch), total + Counter(batch)
        assert {bytes(r.h) for r in runs.common().collect()} == {h for h, n in total.items() if n >= 4}
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    runs.close()
    keys = spark.createDataFrame([(b"hot",)] * 500 + [(bytes([k % 50]),) for k in range(500)], "h binary")
    common = spark.createDataFrame([(b"hot",), *((bytes([k]),) for k in range(30))], "h binary")
    for share in (2, 5, 1_000):
        assert line_dedup.common_pairs(keys, common, share).count() == 800


def repaired_by_search(rows):
    """Rows of (turn, role, text) in order: counts, cost, audit and repaired turns, by search over all edits."""
    seen, state, blank, again, cut, illegal = set(), [], 0, 0, 0, 0
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        fault = "blank" if not end else "again" if (role, text) in seen else "cut" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, again, cut = blank + (fault == "blank"), again + (fault == "again"), cut + (fault == "cut")
        state.append(fault)
    for (_, a, _), (_, b, _) in zip(rows, rows[1:], strict=False):
        illegal += a[:1] + b[:1] not in ("su", "ua", "au")

    @lru_cache(None)
    def best(i, at, inserted):
        ways = [(0, "", ())] if i == len(rows) and at in "0a" else []
        turn = {"0": "user", "s": "user", "a": "user", "u": "assistant"}[at]

        def to(cost, edit, made, *rest):
            c, e, turns = best(*rest)
            ways.append((cost + c, edit + e, made + turns))

        if inserted < 3:
            to(3, "I", ((turn, ""),), i, turn[0], inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            to(4, "D", (), i + 1, at, 0)
            if state[i] not in ("blank", "again"):
                more = 3 if state[i] else 0
                to(3 + more, "R", ((turn, text),), i + 1, turn[0], 0)
                if (role[:1] == turn[0]) or (role[:1] == "s" and at == "0"):
                    to(more, "K", ((role, text),), i + 1, role[0], 0)
        return min(ways, default=(10**9, "", ()))

    cost, audit, turns = best(0, "0", 0)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, blank, again, cut, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def conversation_rows():
    rng = random.Random(9)
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", "useful", "Assistant", None]
    texts = ["Yes.", "No!\n", "What?", "open", "open end ", "", " \t", " ", None, *[f"Sentence {k}." for k in range(12)]]
    out = []
    for c in [None, *range(70)]:
        turns = range(rng.randint(1, 9))
        out += [(c, None if rng.random() < 0.1 else k * rng.randint(1, 2), rng.choice(roles), rng.choice(texts)) for k in turns]
    out += [(500, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(21)] + [(501, 3, "user", "Again.")] * 40 + [(502, None, "system", None)]
    return out


def in_order(rows):
    none = lambda x: " " if x is None else x
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, none(role), none(text)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(own, key=key) for c, own in by.items()}


def test_conversations(spark):
    rows = conversation_rows()
    table = spark.createDataFrame([(c, t, r, x, 1, "c", 2) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, n long, c string, part int")
    original = table.select("conv_id").union(spark.createDataFrame([(999,)], "conv_id long"))
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_report(table, original).collect()}
    want = {c: repaired_by_search(own) for c, own in in_order(rows).items()} | {999: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got == want
    for edits in (w[6] for w in want.values()):
        assert set(edits) <= set("DIKR")
    assert conversation_repair.repair_report(table.limit(0), original.limit(0)).count() == 0


def test_conversations_in_segments(spark):
    """Segments of two rows give what whole conversations give."""
    rows = conversation_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told, turns = conversation_repair.repair(table, segment=2)
    sha = {r.c: r.sha256 for r in conversation_repair.digests(turns).collect()}
    got = {r.c: (*tuple(r)[1:], sha.get(r.c, hashlib.sha256().hexdigest())) for r in told.collect()}
    assert got == {"" if c is None else str(c): repaired_by_search(own) for c, own in in_order(rows).items()}
    roles = turns.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "chunk", "at", F.substring("new_role", 1, 1).alias("r")))), lambda x: x["r"]), "").alias("roles"))
    assert all(re.fullmatch(r"(s?(ua)+)?", r.roles) for r in roles.collect())


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"A. b! {c}?") for c in range(30) for t in (*range(4), None)] + [(None, 1, None, None)]
    got = Counter(map(tuple, queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            want[(c, t, "user" if fault == 4 else role, text)] += 2 if fault == 3 else 1
    assert got == want


def audit_by_loop(rows, labels):
    masks = []
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and any((t2 or "") == t and (d2 is None or d2 < d) for d2, t2, _ in rows) else set()
        own = [x for x in labels if x[0] == d] if d is not None else []
        masks.append((lang or "", fails, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out, share = {}, Counter()
    for part in {m[0] for m in masks}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                mine = [m for m in masks if m[0] == part]
                left = [m for m in mine if not m[1] & set(order[:k])]
                gone = [m for m in left if f in m[1]]
                share[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left) - len(gone), len(gone), sum(f in m[1] for m in mine) - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
    return {key: (*v, share[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(2)
    texts = ["", None, "few words", "A B C D", "word " * 250, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(220)) + " #", "MANY CAPITALS " * 150, "é" * 50, "é" * 50 + "$", "x" * 200_000]
    rows = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(0, 20), *range(5, 9), None]]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masks = filter_audit.failures(documents(spark, rows))
    got = {(r["part"], r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(masks, said).collect()}
    assert got == audit_by_loop(rows, labels)
    assert filter_audit.audit(filter_audit.failures(documents(spark, rows).limit(0)), said.limit(0)).count() == 0


def test_copies_over_boundaries(spark):
    """A group of copies that fills several ranges: all but the smallest doc_id fail."""
    rows = [(k, "copy" if k % 3 else f"own {k}", "en") for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        masks = {r.doc_id: r.mask for r in filter_audit.failures(documents(spark, rows).repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {d for d, m in masks.items() if m & filter_audit.COPY} == {k for k in range(2, 600) if k % 3}
