"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Texts with equal shingle sets form a class and are compared once. 128 MinHash values a class are cut into 32 bands of 4; at similarity 0.8
a pair shares no band with probability (1 - 0.8^4)^32 < 1e-7. Signatures of candidates are compared 16 values at a time: after n
values with m equal, a uniform prior gives P(similarity >= t) = P(Binomial(n + 1, t) <= m), and a pair is dropped as soon as
that falls below ``miss``. Survivors are confirmed on their whole shingle sets.

Every class of a bucket is first compared with the bucket's least class alone, one pair a row, and in buckets of several blocks with a few drawn ones in turns.
What these links join need not be compared again, so groups of copies are done then, however large. Buckets that still hold classes of several components have all pairs of different components
compared: as rows in buckets of up to 32 classes; larger ones are cut into blocks by a hash, and each two blocks meet inside one task, array against
array, first signatures alone; whole sets follow only for classes with a surviving pair there. What leaves such a task is a spanning forest of its
links: fewer rows than it read. No pair is capped; a pair is left to the first band that it shares.

Blocks cost n * n / BLOCK rows in a bucket of n unlike classes, which beyond FINE classes is more than to deal the bucket again: a pair then has to share a
second, later band with the first, and meets in the bucket of both, in at most BANDS * n rows. A pair of similarity 0.8 shares fewer than two bands with
probability 1.1e-6. What is still large is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

HASHES, BANDS, STEP = 128, 32, 16
ROWS = HASHES // BANDS
SMALL, BLOCK = 32, 4_096  # classes of a bucket whose pairs become rows; classes of a block
TURNS, DRAWN, WORTH = 4, 4, 20  # turns in which buckets of several blocks meet drawn classes, so many each, while one class in WORTH finds a link
FINE = 1 << 17  # classes of a bucket, beyond which it is dealt by a second band: n * n / BLOCK rows of blocks would be more than n * BANDS
HELD = 1 << 21  # shingles of a block, so that long texts make smaller blocks
MISS = 1e-9
_RNG = np.random.default_rng(20_240_501)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words, A-Z lower-cased.

    Fewer words than that make one shingle; none, or a null text, the empty set.
    """
    words = text.encode().lower().split() if text else []  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _MUL + _ADD
        np.minimum(best, (part >> np.uint64(32)).astype(np.uint32).min(0), out=best)
    return best


def least_equal(percent: int, miss: float) -> np.ndarray:
    """For 16, 32, ... compared values the fewest equal ones with which a pair still reaches ``percent`` with probability ``miss`` or more."""
    t, out = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Places of the signature pairs (rows of a and b) that no step drops."""
    left, equal = np.arange(len(a)), np.zeros(len(a), int)
    for k, least in enumerate(needed):
        part = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (a[left, part] == b[left, part]).sum(1)
        stays = equal >= least
        left, equal = left[stays], equal[stays]
    return left


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash (null for an empty set) and sig of every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "text_key", "n_shingles", "set_hash", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            made = pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_hash binary, sig binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _pruned(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """a and b of the pairs (a, b, sig_a, sig_b) that sequential pruning leaves."""
    needed = least_equal(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
                yield batch.select([0, 1]).take(pa.array(survivors(a, b, needed)))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """a and b of the pairs (a, b, set_a, set_b) whose whole sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right], pair by pair, from one product of 0/1 arrays for each 4096 shared shingles."""
    rows, i = np.unique(left, return_inverse=True)
    cols, j = np.unique(right, return_inverse=True)
    own = np.union1d(rows, cols)
    values, at = np.unique(np.concatenate([sets[k] for k in own]), return_inverse=True)
    owner = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own])
    shared = np.bincount(at, minlength=len(values)) > 1  # a shingle of one class alone is in no intersection
    number = np.cumsum(shared) - 1
    owner, at = owner[shared[at]], number[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    r, c = np.searchsorted(own, rows), np.searchsorted(own, cols)
    total = np.zeros((len(rows), len(cols)), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(at, (first, first + 4096))
        has = np.zeros((len(own), 4096), np.float32)
        has[owner[lo:hi], at[lo:hi] - first] = 1
        total += has[r] @ has[c].T
    return total[i, j].astype(np.int64)


def _tile(percent: int, miss: float, whole: bool):
    """Compares two blocks of a bucket, or one with itself, but for pairs of one component.

    By signatures alone: key, lo, hi and cid of the classes with a surviving pair. With the ``whole`` sets of these: a spanning forest of their links.
    """
    needed = least_equal(percent, miss)

    def surviving(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block, component, size = (rows[c].to_numpy() for c in ("block", "component", "n_shingles"))
        band, lo, hi = (int(rows[c].iloc[0]) for c in ("band", "lo", "hi"))
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, HASHES)
        mine, other = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        bands = sig.reshape(len(rows), BANDS, ROWS)
        for at in range(0, len(mine), 64):  # 64 rows against a block at a time bound the memory
            left, right = (x.ravel() for x in np.meshgrid(mine[at : at + 64], other, indexing="ij"))
            keep = (left < right) if lo == hi else np.ones(len(left), bool)
            keep &= component[left] != component[right]
            keep &= 100 * np.minimum(size[left], size[right]) >= percent * np.maximum(size[left], size[right])  # sizes alone can rule out
            left, right = left[keep], right[keep]
            for k in range(band):  # an earlier band compares these
                new = ~(bands[left, k] == bands[right, k]).all(1)
                left, right = left[new], right[new]
            place = survivors(sig[left], sig[right], needed)
            if len(place):
                yield left[place], right[place]

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        met = np.zeros(len(rows), bool)
        for left, right in surviving(rows):
            met[left] = met[right] = True
        return rows.loc[met, ["key", "lo", "hi", "cid"]]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        ids, size, root, found = rows["cid"].to_numpy(), rows["n_shingles"].to_numpy(), np.arange(len(rows)), []
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        for left, right in surviving(rows):
            new = root[left] != root[right]  # others are joined already
            left, right = left[new], right[new]
            if not len(left):
                continue
            both = _overlaps(sets, left, right)
            enough = 100 * both >= percent * (size[left] + size[right] - both)
            for i, j in zip(left[enough].tolist(), right[enough].tolist(), strict=True):
                if root[i] != root[j]:
                    root[root == root[i]] = root[j]
                    found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return links if whole else some


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, miss: float = MISS, fine: int = FINE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are not read).

    Rows are linked if their sets of ``width``-word shingles have ``percent`` per cent of their union in common. component_id is the smallest
    doc_id reachable; kept marks the row that has it. Empty and null texts link with nothing and are kept. Rows that repeat a doc_id are
    documents of their own under that id. Null doc_ids are the component's smallest only where it has no other. Texts are read whole, and once more where
    a class shares a bucket.
    """
    made = written(sets_of(docs, width), "sets")
    classes = made.filter("set_hash IS NOT NULL").dropDuplicates(["set_hash"])
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = classes.select("cid", "n_shingles", F.posexplode(keys).alias("band", "key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("rep"), F.sum("n_shingles").alias("held")).filter("n > 1")
    shared = written(banded.join(counts, "key").select("key", "band", "n", "held", "rep", "cid"), "buckets")
    chosen = written(classes.join(shared.select("cid").distinct(), "cid", "left_semi"), "candidates")
    sig, sets = chosen.select("cid", "sig"), written(_sets_again(docs, chosen, width), "shingles")

    def linked(pairs: DataFrame) -> DataFrame:
        """a and b of those of the pairs (a, b) whose sets are alike enough."""
        both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        left = written(_pruned(both, percent, miss), "survivors")
        return written(_confirmed(left.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b"), percent), "links")

    stars = shared.filter("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct()
    roots = written(components(linked(stars)), "components")
    opened = _opened(shared, roots)
    for turn in range(TURNS):
        large = opened.filter(F.col("n") > BLOCK)
        if large.isEmpty():
            break
        drawn = linked(_drawn_pairs(large, turn))
        worth = drawn.count() * WORTH >= large.select("cid").distinct().count()
        roots = written(components(roots.toDF("a", "b").unionByName(drawn)), "components")
        opened = _opened(opened.drop("component"), roots)
        if not worth:
            break
    huge = opened.filter(F.col("n") > fine)
    if not huge.isEmpty():
        opened = opened.filter(F.col("n") <= fine).unionByName(_finer(huge, chosen))
    if not opened.isEmpty():
        more = linked(_row_pairs(opened.filter(F.col("n") <= SMALL))).unionByName(_tile_links(opened.filter(F.col("n") > SMALL), chosen, sets, percent, miss))
        roots = written(components(roots.toDF("a", "b").unionByName(more)), "components")

    by_hash = chosen.select("cid", "set_hash")
    roots = roots.join(by_hash.toDF("node", "set_hash"), "node").join(by_hash.toDF("root", "root_hash"), "root").select("set_hash", "root_hash")
    grouped = made.select("doc_id", "n_shingles", "set_hash").join(written(roots, "roots"), "set_hash", "left")
    grouped = written(grouped.select("doc_id", "n_shingles", F.coalesce("root_hash", "set_hash").alias("group")), "grouped")
    # only groups of several rows are looked up, from a table, so that a join skewed by a large group can be split
    least = grouped.filter("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = written(least.filter("n > 1").select("group", "least"), "groups")
    out = grouped.join(least, "group", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _opened(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``buckets`` with their ``component``, of the buckets of more than two classes that still hold several components."""
    labelled = buckets.filter("n > 2").join(roots.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return written(labelled.join(mixed, "key"), "open-buckets")


def _finer(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``buckets`` dealt again, by the bucket and each later band, without buckets of one class or one component.

    ``band`` stays the first that a pair shares, so that pairs are still left to it. The least class of the first bucket has met all of its own.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    later = F.filter(F.transform(keys, lambda k, i: F.when(i > F.col("band"), F.xxhash64("key", k))), lambda k: k.isNotNull())
    rows = buckets.join(classes.select("cid", "sig", "n_shingles"), "cid").withColumn("key", F.explode(later))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    counts = counts.filter("n > 1 AND low <> high").drop("low", "high")
    return written(rows.select("key", "band", "cid", "rep", "component").join(counts, "key").select(*buckets.columns), "finer-buckets")


def _drawn_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """a and b, each pair once: the classes of a turn's bands with DRAWN classes of their bucket, drawn by hash, of other components."""
    own = buckets.filter(F.col("band") % (BANDS // 4) == turn)
    draw = lambda k: F.min(F.struct(F.xxhash64("cid", F.lit(turn * DRAWN + k)), "cid", "component"))
    drawn = own.groupBy("key").agg(F.array_distinct(F.array(*[draw(k) for k in range(DRAWN)])).alias("d")).select("key", F.explode("d").alias("d"))
    pairs = own.join(drawn, "key").filter(F.col("component") != F.col("d.component"))
    return pairs.select(F.least("cid", "d.cid").alias("a"), F.greatest("cid", "d.cid").alias("b")).distinct()


def _row_pairs(buckets: DataFrame) -> DataFrame:
    """a and b, each pair once, of the classes of different components in small buckets; pairs with a bucket's least class were compared before."""
    side = lambda name: buckets.filter("cid <> rep").select("key", F.col("cid").alias(name), F.col("component").alias(f"of_{name}"))
    return side("a").join(side("b"), "key").filter("a < b AND of_a <> of_b").select("a", "b").distinct()


def _tile_links(buckets: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """a and b: links between the components of large buckets, as spanning forests of pairs of blocks."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("held") / HELD)).cast("int")
    tiles = buckets.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = tiles.select("key", "band", "cid", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    tiles = tiles.join(classes.select("cid", "sig", "n_shingles"), "cid")
    some = tiles.groupBy("key", "lo", "hi").applyInPandas(_tile(percent, miss, False), "key long, lo int, hi int, cid long")
    left = tiles.join(written(some, "tile-survivors"), ["key", "lo", "hi", "cid"]).join(sets, "cid")
    return left.groupBy("key", "lo", "hi").applyInPandas(_tile(percent, miss, True), "a long, b long")


def _sets_again(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """cid and shingles of the ``needed`` classes (cid, doc_id, text_key, set_hash), from the texts of their documents.

    The texts are shuffled by id and hash unless Spark finds the classes few enough to broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sets = [], []
            for cid, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), width).tobytes()
                if xxhash.xxh3_128_digest(s) == key:
                    cids.append(cid)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "shingles"])

    asked = needed.select("cid", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "set_hash")
    texts = _keyed(docs).join(asked, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return texts.select("cid", "set_hash", "text").mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"])
