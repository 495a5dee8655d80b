"""Conversation structure repair: the cheapest edits after which roles read an optional system turn and then user and assistant in turns.

Nodes of the graph are places between rows with one of four states (START, and after a system, user or assistant turn); its arcs keep, rerole, delete or insert a
turn, and cost 0 to 6. Distances to the end come from Dial's bucket queue; the audit is the least walk along tight arcs. Rows that must go (blank or
repeated ones) are no part of the graph: they are deleted where they stand, before anything is inserted there.

A conversation of any length is cut into segments of SEGMENT rows. A segment is summed up by its distances from each state to each, these are added up from the
end of the conversation, and each segment, then told the distances from its end, is walked alone. So only one short row a segment of a conversation
passes through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SEGMENT = 4_096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, FAR, FAR, 0)  # a conversation may end empty or after an assistant turn
TURN = (USER, USER, ASSISTANT, USER)  # the state after the only user or assistant turn that may follow
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))  # the states from which that turn leads here
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": dict.fromkeys((START, SYSTEM, ASSISTANT), USER), "a": {USER: ASSISTANT}, "o": {}}
LEGAL = ("su", "ua", "au")
NO_TURN = -(2**63)  # a null turn
GONE = "bd"  # marks of rows that must go: blank, said before; a truncated row is t, any other a full stop
SPACE = " \t\n\x0b\x0c\r"


def distances(symbols: str, ends: tuple[int, ...], last: bool) -> list[int]:
    """To the end, from each node place * 4 + state, by Dial's bucket queue from the end backward.

    A symbol is a row: s, u, a or o (another role), upper case if truncated. ``ends`` are the distances beyond the segment; only the last one inserts at its end.
    """
    m = len(symbols)
    dist = [FAR] * (4 * m + 4)
    near = min(ends)
    size = max([REROLE + TRUNCATED, DELETE, INSERT, *(e - near for e in ends if e < FAR)]) + 1
    buckets: list[list[int]] = [[] for _ in range(size)]
    for state, e in enumerate(ends):
        if e < FAR:
            dist[4 * m + state] = e
            buckets[(e - near) % size].append(4 * m + state)
    waiting, now = sum(map(len, buckets)), near
    while waiting:
        bucket = buckets[(now - near) % size]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue  # met before at less
            place, state = divmod(node, 4)
            arcs = [(4 * place + s, INSERT) for s in BEFORE[state]] if place < m or last else []
            if place:
                symbol = symbols[place - 1]
                more, first = (TRUNCATED if symbol.isupper() else 0), 4 * place - 4
                arcs.append((first + state, DELETE))
                arcs += [(first + s, KEEP + more) for s, to in KEPT[symbol.lower()].items() if to == state]
                arcs += [(first + s, REROLE + more) for s in BEFORE[state]]
            for to, cost in arcs:
                if now + cost < dist[to]:
                    dist[to] = now + cost
                    buckets[(now + cost - near) % size].append(to)
                    waiting += 1
        now += 1
    return dist


def walk(symbols: str, dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least initials (D, I, K, R) of tight arcs from ``state`` to the end, and the state there."""
    place, m, out = 0, len(symbols), []
    while True:
        d = dist[4 * place + state]
        if place < m and d == DELETE + dist[4 * place + 4 + state]:
            edit, place = "D", place + 1
        elif (place < m or last) and d == INSERT + dist[4 * place + TURN[state]]:
            edit, state = "I", TURN[state]
        elif place == m:
            return "".join(out), state
        else:
            symbol = symbols[place]
            more = TRUNCATED if symbol.isupper() else 0
            kept = KEPT[symbol.lower()].get(state)
            if kept is not None and d == KEEP + more + dist[4 * place + 4 + kept]:
                edit, state, place = "K", kept, place + 1
            else:
                edit, state, place = "R", TURN[state], place + 1
        out.append(edit)


@lru_cache(4_096)
def _across(symbols: str) -> tuple[int, ...]:
    """From each state at the beginning (four by four) to each at the end, without inserts there."""
    columns = [distances(symbols, tuple(0 if s == e else FAR for s in range(4)), False)[:4] for e in range(4)]
    return tuple(columns[e][s] for s in range(4) for e in range(4))


@lru_cache(4_096)
def _walks(symbols: str, ends: tuple[int, ...], last: bool) -> tuple[list[str], list[int], list[int]]:
    """Of each state at the beginning: its edits, where they end, what they cost; no edits where no way leads on."""
    dist = distances(symbols, ends, last)
    told = [walk(symbols, dist, s, last) if dist[s] < FAR else ("", s) for s in range(4)]
    return [t[0] for t in told], [t[1] for t in told], dist[:4]


def prepared(rows: DataFrame) -> DataFrame:
    """c, t, role, h, text and fault (0, 1 blank, 2 truncated) of rows (conv_id, turn, role, text); null roles and texts are one space.

    c is conv_id as text, empty for null; t is the turn, the least long for null; h is the digest of the text.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    end = F.rtrim(text, F.lit(SPACE))
    fault = F.when(end == "", 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    keys = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("t")
    return rows.select(*keys, role.alias("role"), F.unhex(F.sha2(text, 256)).alias("h"), text.alias("text"), fault.alias("fault"))


def judged(rows: DataFrame) -> DataFrame:
    """c, t, role, h, n (equal rows), fault, initial and is_first (no row before has role and text) of prepared rows, equal ones as one."""
    keys = ["c", "t", "role", "h"]
    each = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("fault").alias("fault")), "turns")
    firsts = each.groupBy("c", "role", "h").agg(F.min("t").alias("t"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return each.join(firsts.withColumn("is_first", F.lit(True)), keys, "left").fillna(False, ["is_first"]).withColumn("initial", initial)


TALLIES = ("illegal", "blank", "duplicate", "truncated", "seen", "low", "high")  # of a segment; seen are its distinct turns, from low to high
SEGMENT_KINDS = {
    "c": pa.string(), "part": pa.int32(), "chunk": pa.int64(), "initials": pa.string(), "faults": pa.string(), "counts": pa.list_(pa.int64()), "turns": pa.list_(pa.int64()),
    "roles": pa.list_(pa.string()), "digests": pa.list_(pa.binary()), "across": pa.list_(pa.int64()), **dict.fromkeys(TALLIES, pa.int64()),
}
SEGMENTS = "c string, part int, chunk long, initials string, faults string, counts array<long>, turns array<long>, roles array<string>, digests array<binary>, across array<long>, "
SEGMENTS += ", ".join(f"{t} long" for t in TALLIES)


def _symbols(initials: str, faults: str, counts: list[int]) -> tuple[str, list[int]]:
    """Symbols of the rows that may stay, and how many rows that must go stand before the first and after each."""
    symbols, gone = [], [0]
    for i, f, n in zip(initials, faults, counts, strict=True):
        if f in GONE:
            gone[-1] += n
        else:
            symbols.append(i.upper() if f == "t" else i)
            gone.append(n - 1)
    return "".join(symbols), gone


def _with_deleted(edits: str, gone: list[int]) -> str:
    """The edits of rows that may stay among those of rows that must go: these stand before anything that is inserted at their place."""
    out, e = ["D" * gone[0]], 0
    for n in gone[1:]:
        begin, e = e, e + 1
        while edits[e - 1] == "I":
            e += 1
        out.append(edits[begin:e] + "D" * n)
    return "".join(out) + edits[e:]


def _tallies(initials: str, faults: str, counts: list[int], turns: list[int]) -> tuple:
    illegal = sum(n - 1 for n in counts) + sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
    blank, again = (sum(n for n, f in zip(counts, faults, strict=True) if f == mark) for mark in GONE)
    duplicate = again + sum(n - 1 for n, f in zip(counts, faults, strict=True) if f not in GONE)
    told = [t for t in turns if t != NO_TURN]
    return illegal, blank, duplicate, faults.count("t"), len(set(told)), *((told[0], told[-1]) if told else (None, None))


def _cut(segment: int):
    """Segments of rows that come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, done, held, chunk = [], [], 0, 0

        def closed():
            (c, *_), (part, *_), turns, roles, hashes, counts, initials, faults = zip(*rows, strict=True)
            initials, faults = "".join(initials), "".join(faults)
            across = _across(_symbols(initials, faults, counts)[0])
            return c, part, chunk, initials, faults, counts, turns, roles, hashes, across, *_tallies(initials, faults, counts, turns)

        def batch_of(found):
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), SEGMENT_KINDS.values(), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=list(SEGMENT_KINDS))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("c", "part", "t", "role", "h", "n", "initial", "mark")), strict=True):
                if rows and (rows[-1][0] != row[0] or len(rows) == segment):
                    done.append(closed())
                    held += len(rows)
                    rows, chunk = [], chunk + 1
                    if held >= SEGMENT:
                        yield batch_of(done)
                        done, held = [], 0
                rows.append(row)
        if rows:
            done.append(closed())
        if done:
            yield batch_of(done)

    return run


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments that come last first: the distances from their ends, and which is the last."""
    before, ends = None, ENDS
    for batch in batches:
        c, across, out, last = batch.column("c").to_pylist(), batch.column("across").to_pylist(), [], []
        for conversation, d in zip(c, across, strict=True):
            last.append(conversation != before)
            if last[-1]:
                before, ends = conversation, ENDS
            out.append(ends)
            ends = tuple(distances("", ENDS, True)) if last[-1] else ends  # with what is inserted at the very end
            ends = tuple(min(FAR, *(d[4 * s + e] + ends[e] for e in range(4))) for s in range(4))
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("chunk"), pa.array(out, pa.list_(pa.int64())), pa.array(last)], names=["part", "chunk", "ends", "last"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = []
        for i, f, n, ends, last in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "counts", "ends", "last")), strict=True):
            symbols, gone = _symbols(i, f, n)
            edits, to, costs = _walks(symbols, tuple(ends), last)
            if any(gone):
                edits = [_with_deleted(e, gone) if e or not symbols else e for e in edits]
            told.append((edits, to, costs, DELETE * sum(gone), i[0], i[-1]))
        kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string())
        more = [pa.array([t[k] for t in told], kind) for k, kind in enumerate(kinds)]
        own = ("c", "part", "chunk", *TALLIES)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *more], names=[*own, "edits", "to", "costs", "forced", "head", "tail"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments that come in order: the edits from the state in which the one before ended, the state, the cost, and what they add to the tallies."""
    before, state, tail, last_turn = None, START, "", None
    names = ("c", "edits", "to", "costs", "forced", "head", "tail", "illegal", "seen", "low", "high")
    for batch in batches:
        out = []
        for c, edits, to, costs, forced, head, end, illegal, seen, low, high in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            first = c != before
            if first:
                before, state, last_turn = c, START, None
            pair, same = not first and tail + head not in LEGAL, low is not None and low == last_turn
            out.append((edits[state], state, forced + (costs[state] if first else 0), illegal + pair, seen - same))
            state, tail, last_turn = to[state], end, high
        kinds = {"edits": pa.string(), "state": pa.int32(), "cost": pa.int64(), "illegal": pa.int64(), "seen": pa.int64()}
        told = {x: pa.array([o[k] for o in out], kind) for k, (x, kind) in enumerate(kinds.items())}
        order = ("c", "part", "chunk", *TALLIES, "edits", "state", "cost")
        yield pa.RecordBatch.from_arrays([told[x] if x in told else batch.column(x) for x in order], names=list(order))


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the turns that stay or are inserted."""
    names = ["c", "part", "chunk", "at", "edit", "t", "role", "h", "new_role"]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    columns = ("c", "part", "chunk", "initials", "faults", "counts", "turns", "roles", "digests", "edits", "state")
    for whole in batches:
        for begin in range(0, whole.num_rows, 1_024):  # as many segments stand in memory
            batch, out = whole.slice(begin, 1_024), []
            for c, part, chunk, initials, faults, counts, turns, roles, digests, edits, state in zip(*(batch.column(x).to_pylist() for x in columns), strict=True):
                e = 0
                for i, f, n, *row in zip(initials, faults, counts, turns, roles, digests, strict=True):
                    if f in GONE:
                        e += n
                        continue
                    while edits[e] == "I":
                        state = TURN[state]
                        out.append((c, part, chunk, e, "I", None, None, None, ROLES[state]))
                        e += 1
                    if edits[e] == "R":
                        state = TURN[state]
                        out.append((c, part, chunk, e, "R", *row, ROLES[state]))
                    elif edits[e] == "K":
                        state = KEPT[i][state]
                        out.append((c, part, chunk, e, "K", *row, row[1]))
                    e += n  # of equal rows all but the first go
                for at in range(e, len(edits)):
                    state = TURN[state]
                    out.append((c, part, chunk, at, "I", None, None, None, ROLES[state]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The conversations and the repaired turns of ``rows`` (conv_id, turn, role, text).

    Conversations: c, gaps, blank, duplicate, truncated, illegal, cost and audit, one row for each with rows. Turns: c, part, chunk, at (their order), edit, turn, old and
    new role and text of all that stay, were given another role or were inserted (with an empty text).

    Rows of one turn are in the order of role and digest of the text; null turns come first. A null conv_id is a conversation. A role whose first letter is not s, u or a
    can't stay. Equal rows count each, and all but the first are duplicates; they are one row with a count on the way. Other columns are not read. No rows give none.
    """
    given = prepared(rows)
    marks = F.when(F.col("fault") == 1, "b").when(~F.col("is_first"), "d").when(F.col("fault") == 2, "t").otherwise(".")
    each = judged(given).withColumn("mark", marks)
    order = ["c", "t", "role", "h"]
    dealt = each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    segments = written(dealt.select("c", "part", "t", "role", "h", "n", "initial", "mark").mapInArrow(_cut(segment), SEGMENTS), "segments")

    last_first = segments.select("c", "part", "chunk", "across").repartition("c").sortWithinPartitions("c", F.desc("part"), F.desc("chunk"))
    ends = last_first.mapInArrow(_backward, "part int, chunk long, ends array<long>, last boolean")
    walks = segments.select("c", "part", "chunk", "initials", "faults", "counts", *TALLIES).join(ends, ["part", "chunk"])
    tallies = ", ".join(f"{t} long" for t in TALLIES)
    walks = walks.mapInArrow(_walked, f"c string, part int, chunk long, {tallies}, edits array<string>, to array<int>, costs array<long>, forced long, head string, tail string")
    in_order = walks.repartition("c").sortWithinPartitions("c", "part", "chunk")
    chosen = written(in_order.mapInArrow(_forward, f"c string, part int, chunk long, {tallies}, edits string, state int, cost long"), "edits")

    whole = segments.join(chosen.select("part", "chunk", "edits", "state"), ["part", "chunk"])
    edits = written(whole.mapInArrow(_expanded, "c string, part int, chunk long, at long, edit string, t long, role string, h binary, new_role string"), "turn-edits")

    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "chunk", "edits"))), lambda x: x["edits"]), "")  # as long as the audit
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("seen"), F.lit(0))
    sums = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    told = chosen.groupBy("c").agg(gaps.alias("gaps"), *sums, audit.alias("audit"))

    turn = F.when(F.col("t") > NO_TURN, F.col("t"))
    texts = given.groupBy("c", "t", "role", "h").agg(F.first("text").alias("text"))
    stay = edits.filter("edit IN ('K', 'R')").join(texts, order).select("c", "part", "chunk", "at", "edit", turn.alias("turn"), "role", "new_role", "text")
    added = edits.filter("edit = 'I'").select("c", "part", "chunk", "at", "edit", F.lit(None).cast("long").alias("turn"), "role", "new_role", F.lit("").alias("text"))
    return told, stay.unionByName(added)


def digests(turns: DataFrame) -> DataFrame:
    """c and sha256 of each conversation's repaired turns, ``role:text`` joined by newlines: hashed as a stream, no conversation stands in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state, out = None, None, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "new_role", "text")), strict=True):
                if state is None or c != before:
                    if state is not None:
                        out.append((before, state.hexdigest()))
                    before, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], names=["c", "sha256"])
            out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([state.hexdigest()])], names=["c", "sha256"])

    rows = turns.select("c", "part", "chunk", "at", "new_role", "text").repartition("c").sortWithinPartitions("c", "part", "chunk", "at")
    return rows.select("c", "new_role", "text").mapInArrow(run, "c string, sha256 string")


def repair_report(rows: DataFrame, original: DataFrame) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 of every conv_id of ``original``: zeros, an empty audit and the digest of nothing for one without ``rows``."""
    told, turns = repair(rows)
    ids = original.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c")).distinct()
    out = ids.join(told, "c", "left").join(digests(turns), "c", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    sha = F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), sha)
