"""What one task makes of whole functions: rows sorted by function are cut between functions, and as many functions as a few batches hold are solved at once, as arrays.

Blocks, variables and ids may be of any type that Arrow tells apart; inside they are numbers. Only what one batch of functions needs is held, results go out in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 1 << 17  # rows of a batch of functions, at least
CELLS = 1 << 22  # definitions times blocks (or edges) that are followed at once
SENT = 1 << 16  # rows sent out at once


def whole_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole functions (the first column), none null, of ``batches`` sorted by function."""
    held, rows = [], 0
    for batch in batches:
        if rows >= ROWS:
            ends = pc.index(pc.not_equal(batch.column(0), held[-1].column(0)[-1]), True).as_py()
            if ends >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, ends)])
                held, rows, batch = [], 0, batch.slice(ends)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _functions(column: pa.Array) -> np.ndarray:
    """The number of each row's function."""
    new = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(new)])


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, -1 for null, and the values."""
    told = column.dictionary_encode()
    return told.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary


class _Blocks:
    """Numbers, function by function, of the blocks in two columns of a table of whole functions, -1 for null."""

    def __init__(self, function: pa.Array, one: pa.Array, other: pa.Array):
        of_row = _functions(function)
        codes, values = _codes(pa.concat_arrays([one, other]))
        told, numbers = np.unique(np.where(codes >= 0, np.tile(of_row, 2) * len(values) + codes, -1), return_inverse=True)
        none = int(len(told) > 0 and told[0] < 0)  # nulls come first
        told, numbers = told[none:], numbers - none
        self.one, self.other, self.count = numbers[: len(of_row)], numbers[len(of_row) :], len(told)
        self.function, self._code = told // max(1, len(values)), told % max(1, len(values))
        self._functions, self._values = function.take(pa.array(np.flatnonzero(np.diff(of_row, prepend=-1)))), values

    def columns(self, blocks: np.ndarray) -> list[pa.Array]:
        """The functions and the blocks' values."""
        return [self._functions.take(pa.array(self.function[blocks])), self.values(blocks)]

    def values(self, blocks: np.ndarray) -> pa.Array:
        """The blocks' values, null for -1."""
        return self._values.take(pa.array(np.where(blocks >= 0, self._code[blocks], 0), mask=blocks < 0))


def _ways(of: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``to`` in the order of ``of``, and where each of n begins."""
    return to[np.argsort(of, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def _sent(names: tuple[str, ...], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=list(names))
    for k in range(0, whole.num_rows, SENT):
        yield whole.slice(k, SENT)


def _walk(after: list[int], begins: list[int], n: int) -> tuple[list[int], list[int], list[int]]:
    """A depth-first walk from 0: each one's place in it or -1, who is at each place, and the place of the one before it in the walk's tree."""
    at, place, order, parent, path = begins[:-1], [-1] * n, [0], [0], [0]
    place[0] = 0
    while path:
        v = path[-1]
        k = at[v]
        if k == begins[v + 1]:
            path.pop()
            continue
        at[v] = k + 1
        w = after[k]
        if place[w] < 0:
            place[w] = len(order)
            order.append(w)
            parent.append(place[v])
            path.append(w)
    return place, order, parent


def _nearest(parent: list[int], before: list[int], begins: list[int]) -> list[int]:
    """The nearest dominator of each place of a walk (Lengauer and Tarjan): by semidominators, in m log n steps."""
    n = len(parent)
    semi, label, above, nearest = list(range(n)), list(range(n)), [-1] * n, [0] * n
    first, following = [-1] * n, [-1] * n  # those with a place as their semidominator, as lists

    def least(v):
        if above[v] < 0:
            return v
        path, x = [], v
        while above[above[x]] >= 0:
            path.append(x)
            x = above[x]
        for x in reversed(path):
            u = above[x]
            if semi[label[u]] < semi[label[x]]:
                label[x] = label[u]
            above[x] = above[u]
        return label[v]

    for w in range(n - 1, 0, -1):
        s = w
        for v in before[begins[w] : begins[w + 1]]:
            u = semi[least(v)]
            if u < s:
                s = u
        semi[w], following[w], first[s] = s, first[s], w
        above[w] = p = parent[w]
        v, first[p] = first[p], -1
        while v >= 0:
            u = least(v)
            nearest[v] = u if semi[u] < semi[v] else p
            v = following[v]
    for w in range(1, n):
        if nearest[w] != semi[w]:
            nearest[w] = nearest[nearest[w]]
    return nearest


def _tree(source: np.ndarray, to: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that can be reached, and the nearest dominator of each of n, -1 for none. Edges from -1 lead to entries."""
    after, begins = _ways(source + 1, to + 1, n + 1)
    place, order, parent = _walk(after.tolist(), begins.tolist(), n + 1)
    place, order = np.array(place), np.array(order)
    met = place[source + 1] >= 0
    before, begins = _ways(place[to[met] + 1], place[source[met] + 1], len(order))
    nearest = np.full(n, -1)
    nearest[order[1:] - 1] = order[np.array(_nearest(parent, before.tolist(), begins.tolist()))[1:]] - 1
    return order[1:] - 1, nearest


def nearest_dominators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """function, block, idom of rows (function, block, to) sorted by function; those without block lead to entries."""
    for table in whole_functions(batches):
        blocks = _Blocks(*(c.combine_chunks() for c in table.columns))
        reached, nearest = _tree(blocks.one, blocks.other, blocks.count)
        yield from _sent(("function", "block", "idom"), [*blocks.columns(reached), blocks.values(nearest[reached])])


def all_dominators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """function, block, dominator of the same rows: all blocks go up the tree together, a step at a time, so no chain is held."""
    for table in whole_functions(batches):
        blocks = _Blocks(*(c.combine_chunks() for c in table.columns))
        reached, nearest = _tree(blocks.one, blocks.other, blocks.count)
        block = dominator = reached
        ready, rows = [], 0
        while len(block):
            ready.append((block, dominator))
            rows += len(block)
            dominator = nearest[dominator]
            block, dominator = block[dominator >= 0], dominator[dominator >= 0]
            if rows >= SENT or not len(block):
                of, up = (np.concatenate(x) for x in zip(*ready))
                yield from _sent(("function", "block", "dominator"), [*blocks.columns(of), blocks.values(up)])
                ready, rows = [], 0


def reached(batches: Iterator[pa.RecordBatch], after: bool) -> Iterator[pa.RecordBatch]:
    """function, block, id: the definitions at the beginning of each block, or with ``after`` at its end.

    Rows (function, block, to, id, variable) are sorted by function and id; edges have to, definitions the others. Each definition is followed from its block
    up to the blocks that define its variable again, so the work grows with the pairs found and the edges out of them.
    """
    for table in whole_functions(batches):
        function, block, to, id_, variable = (c.combine_chunks() for c in table.columns)
        blocks, edge = _Blocks(function, block, to), to.is_valid().to_numpy(zero_copy_only=False)
        succ, begins = _ways(blocks.one[edge], blocks.other[edge], blocks.count)
        variables, _ = _codes(variable)
        many, defines = variables.max() + 1, np.flatnonzero(~edge)
        if not len(defines):
            continue
        # of each block and variable the last row, so the highest id
        defined, back = np.unique((blocks.one[defines] * many + variables[defines])[::-1], return_index=True)
        row, home, kind = defines[len(defines) - 1 - back], defined // many, defined % many
        size, edges = np.bincount(blocks.function), np.bincount(blocks.function[blocks.one[edge]], minlength=blocks.function[-1] + 1)
        low = np.concatenate([[0], np.cumsum(size)])[blocks.function[home]]
        width = np.maximum(size, edges)[blocks.function[home]]
        ends = np.cumsum(width)
        start = 0
        while start < len(row):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - width[start] + CELLS, "right")))
            base = ends[start:stop] - width[start:stop] - (ends[start] - width[start]) - low[start:stop]
            seen = np.full(int(ends[stop - 1] - ends[start] + width[start]), -1, np.int32)
            who, at = np.arange(start, stop), home[start:stop]
            found = [(who, at)] if after else []
            while len(who):
                degree = begins[at + 1] - begins[at]
                of = np.repeat(np.arange(len(who)), degree)
                at = succ[np.arange(len(of)) - np.repeat(np.cumsum(degree) - degree - begins[at], degree)]
                who = who[of]
                cell = base[who - start] + at
                new = seen[cell] < 0
                who, at, cell = who[new], at[new], cell[new]
                turn = np.arange(len(cell), dtype=np.int32)
                seen[cell] = turn
                once = seen[cell] == turn
                who, at = who[once], at[once]
                if not after:
                    found.append((who, at))
                key = at * many + kind[who]
                hit = np.minimum(np.searchsorted(defined, key), len(defined) - 1)
                goes = defined[hit] != key
                who, at = who[goes], at[goes]
                if after:
                    found.append((who, at))
            who, at = (np.concatenate(x) for x in zip(*found))
            yield from _sent(("function", "block", "id"), [*blocks.columns(at), id_.take(pa.array(row[who]))])
            start = stop
