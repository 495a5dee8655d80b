"""Token counts by byte-pair merging, without making the identifiers.

A piece's symbols stand in a linked list and its mergeable neighbours in a heap by rank. The lowest rank is popped,
stale entries are skipped, and the two new neighbours are pushed. The count is the initial symbols less the merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A space before a character that isn't white space always starts a pre-token of the byte-level pattern.
_STARTS = re.compile(r" (?=\S)")
_RUN = re.compile(r" \s| \Z")
_ID_BITS = 24


def split_at_spaces(text: str) -> list[str]:
    """Chunks whose pre-tokens, each chunk after the first led by a space again, are those of the text."""
    return _STARTS.split(text) if _RUN.search(text) else text.split(" ")


class _Counts(dict):
    """Counts of chunks, made when first asked for and kept up to ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, chunk: str) -> int:
        n = self.make(chunk)
        if len(self) < self.limit and len(chunk) <= 64:
            self[chunk] = n
        return n


class MergeCounter:
    """Counts tokens as a ``tokenizers`` JSON file of kind BPE gives them, added tokens inside texts included.

    The library cuts texts into pre-tokens; the merging is done here. ``kept`` bounds the remembered chunks.
    """

    def __init__(self, path: str, kept: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer",) if spec.get(k)]
        odd += [k for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain byte-pair model: {model.get('type')}, {odd}")
        vocab = model["vocab"]
        self.ids = {s: i for s, i in vocab.items() if len(s) == 1}
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a] << _ID_BITS | vocab[b]] = rank << _ID_BITS | vocab[a + b]
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.by_spaces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = _Counts(self.merged, kept)
        self.first = _Counts(self._chunk, kept // 20)
        self.later = _Counts(lambda chunk: self._chunk(" " + chunk), kept)

    def merged(self, piece: str) -> int:
        """Initial symbols of one pre-token less its merges."""
        pairs = self.pairs
        sym = [self.ids[c] for c in piece if c in self.ids]
        n = len(sym)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get(sym[i] << _ID_BITS | sym[i + 1])
            if found is not None:
                heap.append((found, i))
        heapify(heap)
        merges = 0
        while heap:
            found, i = heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or pairs.get(sym[i] << _ID_BITS | sym[j]) != found:
                continue  # one of the two has merged otherwise meanwhile
            merges += 1
            new = sym[i] = found & (1 << _ID_BITS) - 1
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get(new << _ID_BITS | sym[k])
                if found is not None:
                    heappush(heap, (found, i))
            h = before[i]
            if h >= 0:
                found = pairs.get(sym[h] << _ID_BITS | new)
                if found is not None:
                    heappush(heap, (found, h))
        return n - merges

    def _chunk(self, chunk: str) -> int:
        pieces = self.pieces
        return sum([pieces[p] for p, _ in self.cut(chunk)])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        return sum(map(self._plain, self.added.split(text))) + sum(1 for _ in self.added.finditer(text))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_spaces:
            return self._chunk(text)
        chunks = split_at_spaces(text)
        return self.first[chunks[0]] + sum(map(self.later.__getitem__, chunks[1:]))


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8) and ``n_tokens`` to every row, without a shuffle.

    The file at ``tokenizer_path`` is read on every executor. A null or empty text has 0 of both; repeated rows stay; columns of
    ``docs`` with the new names are replaced. A text is counted whole however long it is, in n log n steps.
    """
    kept = docs.drop(n_bytes, n_tokens)
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in batches:
            texts = batch.column(at)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens = pa.array([count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, tokens], names=[*batch.schema.names, n_bytes, n_tokens])

    return kept.mapInArrow(run, schema)


def token_report(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the document has more than ``limit`` tokens."""
    counted = count_tokens(docs.select("doc_id", "text"), tokenizer_path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
