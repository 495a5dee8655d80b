"""Exact top-k by inner product over integer vectors, block at a time.

A vector's non-zero dimensions are its terms. Vectors are ordered by content, the nearest of SEEDS seed vectors, and then by vec_id, and dealt in
ranges of neighbours; a range holds blocks of BLOCK vectors, each with a forward index (its vectors as rows of an array) and, for every
dimension, the greatest and least value in the block. For a query the bound of a block is the sum over the dimensions of the query's value times
the block's greatest value (least where the query's is negative). A query visits blocks by falling bound and stops when the bound falls
below its k-th score so far.

First each query meets its own range, of vectors like it; its k-th score there is the floor below which no block of any other range is
visited and no row leaves a task. Then tiles of a query group and a further range are compared in one task each. There are RANGES ranges however
large the table, until one would exceed LONGEST vectors, so what leaves the tiles grows with the queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, EVERY, SCALE = 20, 20, 64
BLOCK = 256
RANGES, LONGEST, WIDEST = 8, 32_768, 1 << 22  # ranges of a small table; most vectors, and numbers, in one
QUERIES = (1_024, 8_192)  # least and most queries of a group
GROUPS = 64  # query groups before they grow
SEEDS = 64  # vectors that order the others
PENDING = 1 << 20  # candidates of a tile that are held before they are cut to k a query
EXACT = float(2**53)  # sums below this are whole in a double
_LONG = 2**63 - 1
_FOUND = "query_row long, query_id long, row long, vec_id long, score long"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, short ones padded with 0, long ones cut."""
    array = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = array.offsets.to_numpy()
    values, length = array.values.to_numpy(zero_copy_only=False), np.diff(ends)
    if len(length) and width and (length == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width).astype(float)
    out = np.zeros((len(length), width))
    for i, (start, n) in enumerate(zip(ends, np.minimum(length, width), strict=False)):
        out[i, :n] = values[start : start + n]
    return out


def _longest(vectors: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in vectors.chunks), default=0)


def _dots(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all of d, within a long."""
    found = q @ d.T
    return np.clip(found, -_LONG, _LONG) if found.dtype == object else found


def _cut(hits: list[np.ndarray], k: int, ids: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The k best of each query among hits (query, place, score): by score, ties by vec_id, then row."""
    query, place, score = (np.concatenate(x) for x in hits)
    if score.dtype == object:
        order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], ids[place[i]], rows[place[i]])), int)
    else:
        order = np.lexsort((rows[place], ids[place], -score, query))
    query, place, score = query[order], place[order], score[order]
    first = np.searchsorted(query, query)
    few = np.arange(len(query)) - first < k
    return [[query[few]], [place[few]], [score[few]]]


def _tile(k: int, seen: tuple[Accumulator, Accumulator] | None):
    def best(rows: pa.Table) -> pa.Table:
        width = _longest(rows["v"])
        queries = rows.filter(rows["asks"])
        docs = rows.filter(pc.invert(rows["asks"])).sort_by("row")
        none = pa.table({n: pa.array([], pa.int64()) for n in _NAMES})
        if not len(queries) or not len(docs):
            return none
        q, d = _matrix(queries["v"], width), _matrix(docs["v"], width)
        if np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * max(width, 1) >= EXACT:  # Python integers lose no digit
            q, d = (np.array([[int(x) for x in row] for row in m], object).reshape(len(m), width) for m in (q, d))
        ids, row = docs["vec_id"].to_numpy(), docs["row"].to_numpy()
        own = queries["row"].to_numpy()
        starts = range(0, len(d), BLOCK)
        high, low = (np.array([f(d[s : s + BLOCK], axis=0) for s in starts]) for f in (np.max, np.min))
        bound = _dots(np.maximum(q, 0), high) + _dots(np.minimum(q, 0), low)
        if bound.dtype == object:
            bound = np.clip(bound, -_LONG, _LONG)
        # a bound is at least the score of any vector of its block
        order = np.argsort(-bound, axis=1, kind="stable")
        lowest = -_LONG - 1 if q.dtype == object else -np.inf
        floor = np.array([lowest if f is None else f for f in queries["floor"].to_pylist()], q.dtype)
        top = np.full((len(q), k), lowest, q.dtype)  # the k best scores so far
        best_last = np.sort if q.dtype == object else lambda a, axis: np.partition(a, a.shape[1] - k, axis=axis)
        at, hits, pending, visited = np.arange(len(q)), [[], [], []], 0, 0
        for step in range(len(starts)):
            block = order[:, step]
            worth = bound[at, block] >= floor
            if not worth.any():
                break  # later bounds are lower still
            for b in np.unique(block[worth]):
                who = at[worth & (block == b)]
                visited += len(who)
                place = np.arange(starts[b], min(starts[b] + BLOCK, len(d)))
                found = _dots(q[who], d[place])
                others = row[place][None, :] != own[who][:, None]
                i, j = np.nonzero((found >= floor[who][:, None]) & others)
                for held, new in zip(hits, (who[i], place[j], found[i, j]), strict=True):
                    held.append(new)
                pending += len(i)
                found[~others] = lowest
                top[who] = best_last(np.concatenate([top[who], found], axis=1), 1)[:, -k:]
                floor[who] = np.maximum(floor[who], top[who].min(axis=1))
                if pending > PENDING:
                    hits = _cut(hits, k, ids, row)
                    pending = len(hits[0][0])
        if seen:
            seen[0].add(visited)
            seen[1].add(len(q) * len(starts))
        if not pending:
            return none
        (who,), (place,), (score,) = _cut(hits, k, ids, row)
        columns = own[who], queries["vec_id"].to_numpy()[who], row[place], ids[place], np.array([int(x) for x in score], np.int64)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(_NAMES, columns, strict=True)})

    return best


def _by_content(sound: DataFrame, seeds: int) -> DataFrame:
    """Adds ``near``, the number of the seed with the greatest cosine, to vec_id and v.

    Seeds are one vector for each value of a hash modulo ``seeds``, so repeats of one vector are one seed at most. They only order rows.
    """
    h = F.xxhash64("v")
    chosen = sound.filter(F.size("v") > 0).groupBy(F.pmod(h, F.lit(seeds)).alias("k")).agg(F.min_by("v", F.xxhash64("v", F.lit("seed"))).alias("v")).orderBy("k").collect()
    width = max((len(r.v) for r in chosen), default=0)
    centre = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        centre[i, : len(r.v)] = r.v
    with np.errstate(all="ignore"):
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)

    def run(batches):
        for batch in batches:
            with np.errstate(all="ignore"):
                score = np.nan_to_num(_matrix(batch.column(1), width) @ centre.T) if len(centre) else np.zeros((batch.num_rows, 1))
            near = score.argmax(1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "v", "near"])

    return sound.mapInArrow(run, "vec_id long, v array<double>, near int")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, seen: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` highest inner products of each query, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; components become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``, candidates
    all rows but the query's own. Rows with a null vec_id or vector, or a null or non-finite component, take no part. Vectors of several lengths compare
    over the common dimensions; an empty one scores 0. A repeated vec_id is a row, and a query, of its own each time; ties between its rows
    fall to a fixed order. A score beyond a long counts as the long's limit. Other columns are not read.
    ``seen``: two accumulators, to which the pairs of query and block that were visited, and all of them, are added.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # floor() gives a long, which the largest floats exceed; this stays a double
    def floored(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)

    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad)
    sound = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", floored).alias("v"))
    near = _by_content(sound, SEEDS).repartitionByRange("near", "vec_id").sortWithinPartitions("near", "vec_id")
    near = written(near.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = near.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("width")).first()
    # places from counts of the written partitions: ranges of neighbours
    part = F.shiftright("row", 33).cast("int")
    length = min(LONGEST, max(1, WIDEST // max(sizes.width or 1, 1)), max(BLOCK, -(-sizes.n // RANGES)))
    ranges = -(-sizes.n // length) or 1
    asked = -(-sizes.q // min(QUERIES[1], max(QUERIES[0], sizes.q // GROUPS))) or 1
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a partition
    before = near.groupBy(part.alias("part")).agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(so_far) - F.col("c")).select("part", "before")
    placed = near.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1))
    placed = placed.select("vec_id", "row", "v", F.floor(F.col("place") / length).cast("int").alias("range"))
    docs = placed.withColumn("floor", F.lit(None).cast("long")).withColumn("asks", F.lit(False))
    queries = placed.filter(F.col("vec_id") % every == 0).withColumn("asks", F.lit(True))

    # each query in its own range: the best of it, and the floor for the others
    first = docs.unionByName(queries.withColumn("floor", F.lit(None).cast("long")))
    home = written(first.groupBy("range").applyInArrow(_tile(k, seen), _FOUND), "home")
    floors = home.groupBy(F.col("query_row").alias("row")).agg(F.min("score").alias("floor"), F.count("*").alias("c"))
    floors = floors.select("row", F.when(F.col("c") >= k, F.col("floor")).alias("floor"))

    others = F.filter(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda r: r != F.col("range"))
    asking = queries.join(floors, "row", "left").withColumn("asked", F.pmod(F.xxhash64("row"), F.lit(asked)).cast("int")).withColumn("range", F.explode(others))
    sent = docs.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    rest = sent.unionByName(asking).groupBy("asked", "range").applyInArrow(_tile(k, seen), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return home.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
