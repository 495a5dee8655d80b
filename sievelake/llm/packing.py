"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

A bin holds at most one document of a source and one of a duplicate cluster; it carries a bitmap of each. Documents are dealt by hash into shards of
about SHARD rows, which pack independently: a bin never spans shards, so neither do conflicts, and a hot source or cluster is spread over
all shards. In a shard, longest first, the residuals in use stand in a sorted list, each with its bins; the search starts at the
smallest residual that is large enough and goes on to the next until a bin is compatible, the tightest that there is. A residual all of whose bins have
the source is passed over at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, written
from .mixing import word_count

CAPACITY, SHARD = 2_048, 4_096


class Shard:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity, self.residuals, self.at = capacity, [], {}
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []
        self.full: dict[tuple[int, int], int] = {}  # (residual, source bit): bins there that have it

    def _enter(self, b: int) -> None:
        r = self.left[b]
        if r not in self.at:
            self.at[r] = {}
            insort(self.residuals, r)
        self.at[r][b] = None
        self._count(b, r, 1)

    def _leave(self, b: int) -> None:
        r = self.left[b]
        del self.at[r][b]
        self._count(b, r, -1)
        if not self.at[r]:
            del self.at[r]
            del self.residuals[bisect_left(self.residuals, r)]

    def _count(self, b: int, r: int, by: int) -> None:
        bits = self.sources[b]
        while bits:
            low = bits & -bits
            self.full[r, low] = self.full.get((r, low), 0) + by
            bits ^= low

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of the next document; ``source`` and ``cluster`` are single bits, or 0 for no conflict."""
        for k in range(bisect_left(self.residuals, size), len(self.residuals)):
            r = self.residuals[k]
            if source and self.full.get((r, source), 0) == len(self.at[r]):
                continue
            for b in self.at[r]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    return self._add(b, size, source, cluster)
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self._enter(len(self.left) - 1)
        return self._add(len(self.left) - 1, size, source, cluster)

    def _add(self, b: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        self._leave(b)
        offset = self.capacity - self.left[b]
        self.left[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self._enter(b)
        return b, offset


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "doc_id", "cluster", "text_key"], ascending=[False, True, True, True, True], kind="stable")
        shard, bits, seen = Shard(capacity), {}, {}
        repeated = rows["cluster"].duplicated(keep=False) & rows["cluster"].notna()
        out = []
        columns = (rows[c] for c in ("doc_id", "text_key", "source", "size", "cluster"))
        for doc_id, key, source, size, cluster, again, number in zip(*columns, repeated, rows["shard"], strict=True):
            source = "" if source is None else f"={source}"
            first = number << 32
            whole, rest = divmod(int(size), capacity)
            s, c = (1 << bits.setdefault(source, len(bits)), (1 << seen.setdefault(cluster, len(seen))) if again else 0) if size else (0, 0)
            for piece in range(whole + (rest > 0 or not whole)):
                n = capacity if piece < whole else rest
                b, offset = shard.place(n, s, c)
                out.append((doc_id, key, piece, piece * capacity, n, first + b, offset))
        out = pd.DataFrame(out, columns=["doc_id", "text_key", "piece", "first_word", "n_words", "bin_id", "bin_offset"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """doc_id, text_key, piece, first_word, n_words, bin_id and bin_offset: where the words of every row of ``docs`` (doc_id, text, source) go.

    text_key is a hash of the text: with doc_id, which may repeat after a mix, it tells which text a piece is of.

    A document of more than ``capacity`` words gives full pieces, a bin each, and a last one that shares a bin. Nothing is cut off or left out. Rows of the same
    words (A-Z lower-cased) are a cluster; a null source is a source. A text without words has one piece of 0 words and conflicts with nothing. Repeated
    rows are documents of their own. Reruns agree: order and shards come from hashes. Other columns are not read.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), 0)
    size = word_count(F.col("text"))
    cluster = F.when(size > 0, F.xxhash64(words))
    ids = F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")
    sized = docs.select(*ids, size.alias("size"), cluster.alias("cluster"), F.xxhash64("text").alias("text_key"))
    sized = written(sized, "pack-sizes")
    shards = max(1, -(-sized.count() // shard))
    order = F.xxhash64("doc_id", "cluster", F.lit("pack"))
    dealt = sized.withColumn("order", order).withColumn("shard", F.pmod(F.col("order"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack(capacity), "doc_id long, text_key long, piece long, first_word long, n_words long, bin_id long, bin_offset long")


def packed_texts(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """bin_id and text: each bin's pieces in the order of their offsets, joined by blank lines. A bin has at most its capacity of words.

    Pieces find their text by doc_id and text_key, so doc_ids may repeat or be null; equal rows of ``docs`` are one text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), "text").dropDuplicates(["_id", "_key"])
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    part = F.array_join(F.slice(words, F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), " ")
    pieces = packed.filter("n_words > 0").join(texts, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("part", part)
    own = F.sort_array(F.collect_list(F.struct("bin_offset", "part")))
    return pieces.groupBy("bin_id").agg(F.array_join(F.transform(own, lambda p: p["part"]), "\n\n").alias("text"))
