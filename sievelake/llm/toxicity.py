"""Toxicity by weak supervision.

1. From a bounded sample of labelled documents, words and word beginnings that toxic ones have far more often are mined, with Spark's own counts.
2. Voters: fixed lexicons, what was mined by kind (words, short and long beginnings, beginnings that many of a text's words share), and patterns.
   Every document is voted on; only counts of vote patterns leave the executors.
3. The generative label model (label_model) estimates the voters' accuracies and correlations from those counts and gives each pattern's posterior.
4. A sparse linear classifier over the telling words, word beginnings and votes learns the posterior labels of the sample, and is calibrated on the labels of a fifth of it.
5. Every document is scored by the classifier on its whole text.

A feature is a 64-bit hash whose lowest bits tell its kind: 0 a whole word, 3 to 7 a beginning of so many letters, and 8 more for a beginning that is
dense in the text, i.e. of at least one in DENSE of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, written
from .label_model import LabelModel
from .linear import Ftrl

#: Words of the three lexicons, and marks of patterns.
PEOPLE = frozenset("idiot moron loser clown scum fool jerk imbecile cretin bastard pig".split())
QUALITIES = frozenset("stupid worthless pathetic disgusting trash dumb garbage ugly filthy vile".split())
DEEDS = frozenset("hate kill die hurt destroy shut suck rot".split())
SHOUT = re.compile(r"!{2,}|\?!")
MASKED = re.compile(r"\b\w+\*{2,}\w*")
ADDRESS = re.compile(rf"\b(?:you|your|you're)\W+(?:\w+\W+){{0,3}}?(?:{'|'.join(sorted(PEOPLE | QUALITIES))})", re.IGNORECASE)

LABELLED, EPOCHS = 5_000, 3  # bound: labelled documents fitted on; passes
SLICE = 256  # sampled documents whose features stand in memory at once
DENSE = 100  # words of a text, of which one must have a beginning for it to be dense
BEGINNINGS = (3, 4, 5, 6, 7)
KIND, DENSER = np.uint64(15), np.uint64(8)
WORDS = re.compile(r"[^\W\d_]+")
VOTERS = ("people", "qualities", "deeds", "words", "short beginnings", "long beginnings", "dense beginnings", "several", "shouting", "masked", "capitals", "stretched", "addressed", "nothing")
MARKS = VOTERS[8:13]
THRESHOLD = 0.3
_hash = xxhash.xxh3_64_intdigest


def _keyed(text: str, kind: int) -> int:
    return _hash(text) & ~15 | kind


class _Parts(dict):
    """Hashes of the words in a token and of their beginnings, as bytes, made when first asked for; up to ``kept`` tokens are remembered."""

    kept = 150_000

    def __missing__(self, token: str) -> bytes:
        words = WORDS.findall(token)
        keys = [_keyed(w, 0) for w in words] + [_keyed(w[:n], n) for w in words for n in BEGINNINGS if len(w) >= n]
        found = np.array(keys, np.uint64).tobytes()
        if len(self) < self.kept and len(token) <= 64:
            self[token] = found
        return found


_PARTS = _Parts()


def parts(text: str | None) -> np.ndarray:
    """Hashes of the words and word beginnings of a whole text's distinct tokens, lower-cased, some of them repeated."""
    tokens = set(text.lower().split()) if text else ()
    return np.frombuffer(b"".join(map(_PARTS.__getitem__, tokens)), np.uint64)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct ones of a text's parts, and once more as dense those that are."""
    every = parts(text)
    found, n = np.unique(every, return_counts=True)
    dense = (n * DENSE >= np.count_nonzero((every & KIND) == 0)) & ((found & KIND) > 0)
    return np.sort(np.concatenate([found, found[dense] | DENSER]))


def _lexicon(words: frozenset[str]) -> np.ndarray:
    return np.unique(np.array([_keyed(w, 0) for w in words], np.uint64))


_PEOPLE, _QUALITIES, _DEEDS = map(_lexicon, (PEOPLE, QUALITIES, DEEDS))
_FIXED = np.unique(np.concatenate([_PEOPLE, _QUALITIES, _DEEDS]))


class Telling:
    """Telling features, sorted, made ready for search: which voters of words each is for, and where it stands as present and as dense."""

    def __init__(self, values: np.ndarray):
        self.values, self.plain, kind = values, np.unique(values & ~DENSER), values & KIND
        self.present, self.dense = (self._places(self.plain | bit) for bit in (np.uint64(0), DENSER))
        fixed = [np.isin(values, lexicon) for lexicon in (_PEOPLE, _QUALITIES, _DEEDS)]
        mined = ~np.logical_or.reduce(fixed)
        kinds = [kind == 0, (kind >= 3) & (kind <= 4), (kind >= 5) & (kind <= 7), kind >= 8]
        self.of = np.array([*fixed, *(mined & k for k in kinds)]).T
        self.word = np.searchsorted(self.plain, values & ~DENSER)

    def _places(self, features: np.ndarray) -> np.ndarray:
        """Places of the features among the values; -1 of those that are not there."""
        at = np.minimum(np.searchsorted(self.values, features), len(self.values) - 1)
        return np.where(self.values[at] == features, at, -1)

    def hits(self, text: str | None) -> np.ndarray:
        """Places of those of the values that the text has."""
        mine = parts(text)
        if not len(mine):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.plain, mine), len(self.plain) - 1)
        at, n = np.unique(at[self.plain[at] == mine], return_counts=True)
        if not len(at):
            return at
        dense = at[n * DENSE >= np.count_nonzero((mine & KIND) == 0)]
        places = np.concatenate([self.present[at], self.dense[dense]])
        return np.sort(places[places >= 0])

    def votes(self, marked: tuple[int, ...], own: np.ndarray) -> list[int]:
        """The voters' votes, in the order of VOTERS; ``marked`` are the text's marks, ``own`` the places that it has."""
        if not len(own):
            return [0] * (self.of.shape[1] + 1) + [*marked, -int(not any(marked))]
        several = len(own) >= 3 and len(np.unique(self.word[own])) >= 3
        return [*self.of[own].any(0).astype(int).tolist(), int(several), *marked, 0]


def marks(text: str | None) -> tuple[int, ...]:
    """The votes of the patterns over a whole text: shouting, masked, capitals, stretched, addressed.

    Capitals: more than half of its letters A-Z, ten of them at least. Stretched: a letter A-Z four times in a row.
    """
    text = text or ""
    code = np.frombuffer(text.encode(errors="replace"), np.uint8)
    upper, lower = (int(np.count_nonzero(code - np.uint8(first) < 26)) for first in (65, 97))
    same = code[1:] == code[:-1]
    stretched = same[2:] & same[1:-1] & same[:-2]
    if stretched.any():
        stretched = stretched & ((code[3:] | np.uint8(32)) - np.uint8(97) < 26)
    masked = "**" in text and MASKED.search(text)
    return tuple(int(bool(v)) for v in (SHOUT.search(text), masked, upper >= 10 and upper > lower, stretched.any(), "you" in text.lower() and ADDRESS.search(text)))


def distinct(least: np.ndarray, alike: float = 0.5) -> list[int]:
    """Places of examples that are no near copies of an earlier one, by their least hashes (rows): of those that share a band of 4, the share of equal ones tells."""
    firsts: dict[tuple, int] = {}
    kept = []
    for k, own in enumerate(least):
        bands = [(b, *own[4 * b : 4 * b + 4].tolist()) for b in range(least.shape[1] // 4)]
        others = {firsts[b] for b in bands if b in firsts}
        if not any((own == least[o]).mean() >= alike for o in others):
            kept.append(k)
        for b in bands:
            firsts.setdefault(b, k)
    return kept


_MUL = np.random.default_rng(7).integers(1, 2**63, 48, dtype=np.uint64) | np.uint64(1)


def _least(found: np.ndarray) -> np.ndarray:
    return np.array([int((found * m >> np.uint64(8)).min()) for m in _MUL], np.int64) if len(found) else np.full(len(_MUL), -1, np.int64)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """n, features, least hashes, text, marks and label of about LABELLED labelled documents, a seeded sample, as a written table.

    Documents are drawn by doc_id; of rows that share a drawn id again by id and text, so that hot ids give no more. Equal rows count once.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = lambda n: int(min(1.0, LABELLED / max(n, 1)) * (1 << 30))
    drawn = lambda *key: F.pmod(F.xxhash64(*key, F.lit("toxicity")), F.lit(1 << 30))
    few = usable.select(F.col("doc_id").alias("_id"), "toxic").filter(drawn("doc_id") < share(usable.count()))
    few = written(few, "toxicity-labels")  # LABELLED rows expected, of 12 bytes
    mine = docs.join(F.broadcast(few), docs["doc_id"] == few["_id"]).withColumn("_h", F.xxhash64("text"))
    matched = docs.select("doc_id").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).count()
    if matched > 2 * LABELLED:
        mine = mine.filter(drawn("_id", "_h") < share(matched))
    mine = mine.dropDuplicates(["_id", "_h"]).select("text", "toxic", F.xxhash64("_id", "_h", F.lit("order")).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):  # a slice's features alone stand in memory
                batch = whole.slice(start, SLICE)
                found = [features(t.as_py()) for t in batch.column(0)]
                own = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
                least = pa.array([_least(f).tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(1), own, least], names=["n", "text", "toxic", "features", "least"])

    return written(mine.mapInArrow(run, "n long, text string, toxic int, features array<long>, least binary"), "toxicity-sample")


def mine(sample: DataFrame) -> np.ndarray:
    """Sorted features that toxic examples of the sample have more often than chance explains, however many; the classifier's penalty chooses among them.

    A feature of n examples, ``bad`` of them toxic, is kept if its log likelihood ratio against the overall share exceeds log(features) + 3, so that
    among all features a chance one is unlikely to pass. Near copies of an earlier example are left out: they would make each of their words look telling.
    """
    rows = sample.select("n", "least", "toxic").orderBy("n").toArrow()  # 400 bytes a row
    least = np.frombuffer(b"".join(rows["least"].to_pylist()), np.int64).reshape(-1, len(_MUL))
    single = np.array([k for k in distinct(least) if least[k][0] != -1], int)
    toxic = rows["toxic"].to_numpy()[single] == 1
    if not toxic.any() or toxic.all():
        return np.empty(0, np.uint64)
    share = float(toxic.mean())
    kept = sample.sparkSession.createDataFrame(pa.table({"n": rows["n"].take(pa.array(single))}))
    each = sample.join(F.broadcast(kept), "n").select(F.explode("features").alias("feature"), (F.col("toxic") == 1).cast("long").alias("bad"))
    counted = written(each.groupBy("feature").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "toxicity-features")
    rate, good = F.col("bad") / F.col("n"), F.col("n") - F.col("bad")
    part = lambda n, p, q: F.when(n > 0, n * F.log(p / q)).otherwise(0.0)
    gain = part(F.col("bad"), rate, F.lit(share)) + part(good, 1 - rate, F.lit(1 - share))
    strong = counted.filter(rate > max(0.5, share)).withColumn("gain", gain).filter(F.col("gain") > float(np.log(max(counted.count(), 1)) + 3))
    return np.sort(strong.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))


def evidence(docs: DataFrame, values: np.ndarray, text: str = "text", named: tuple[str, str] = ("_hits", "_votes")) -> DataFrame:
    """``docs`` without its text but with the places of its telling features among ``values`` (4 bytes each) and its votes (one byte each, plus 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(values)
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(sent.value)
        for batch in batches:
            own, cast = [], []
            for t in batch.column(len(others)):
                t = t.as_py()
                at = telling.hits(t)
                own.append(at.astype("<i4").tobytes())
                cast.append(bytes(v + 1 for v in telling.votes(marks(t), at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(own, pa.binary()), pa.array(cast, pa.binary())], names=[*others, *named])

    schema = T.StructType([*docs.select(*others).schema.fields, *(T.StructField(n, T.BinaryType()) for n in named)])
    return docs.select(*others, text).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list]:
    """The telling features, sorted, and the sample as (places of features, votes, label), from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    sample = _sample(docs, labels)
    values = np.union1d(mine(sample), _FIXED)
    rows = evidence(sample.select("n", "toxic", "text"), values).toArrow().sort_by("n")
    return values, list(zip(*(rows[c].to_pylist() for c in ("_hits", "_votes", "toxic")), strict=True))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The classifier: features, their weights, vote weights, bias, and the label model.

    Only ``labels`` rows given here are learnt from. Without labels, or with one class only, nothing is mined and the fixed voters carry the model.
    """
    values, sample = learn(docs, labels)
    return fit_sample(values, sample, patterns(evidence(docs.select("text"), values)))


def patterns(voted: DataFrame) -> list:
    """Counts of vote patterns over all rows, in order; 3^14 rows at most."""
    return voted.groupBy("_votes").agg(F.count("*").alias("n")).orderBy("_votes").collect()


def fit_sample(values: np.ndarray, sample: list, counted: list) -> dict:
    """The classifier from the telling features, the sample's places, votes and labels, and the counts (_votes, n) of vote patterns over all documents."""
    unpack = lambda rows: np.array([[b - 1 for b in bytes(r)] for r in rows], int).reshape(-1, len(VOTERS))
    voted, toxic = unpack([v for _, v, _ in sample]), np.array([label == 1 for *_, label in sample], bool)
    labelled, repeats = np.unique(np.column_stack([voted, toxic]), axis=0, return_counts=True)
    known = np.concatenate([np.full(len(counted), -1), labelled[:, -1]])
    model = LabelModel(np.vstack([unpack([r._votes for r in counted]), labelled[:, :-1]]), known, np.concatenate([[r.n for r in counted], repeats]))
    target = model.posterior(voted)

    learner = Ftrl(2, len(values) + len(VOTERS), alpha=0.3, l1=0.3, l2=0.1)
    rows = [np.concatenate([np.frombuffer(own, "<i4"), len(values) + np.flatnonzero(v)]) for (own, *_), v in zip(sample, voted, strict=True)]
    signs = [np.concatenate([np.ones(len(a) - np.count_nonzero(v)), v[v != 0]]) for a, v in zip(rows, voted, strict=True)]
    fitted, calibrating = [k for k in range(len(rows)) if k % 5 != 4], [k for k in range(len(rows)) if k % 5 == 4]
    for _ in range(EPOCHS):
        for k in fitted:
            learner.learn(rows[k], signs[k], np.array([1 - target[k], target[k]]))
    w, b = learner.model()
    w, b = w[1] - w[0], float(b[1] - b[0])
    if not fitted:  # nothing to learn from: the label model's own odds of each vote
        odds = [table[1, parent, cast] - table[0, parent, cast] for table, parent, cast in ((t, 1, 0 if name == "nothing" else 2) for t, name in zip(model.tables, VOTERS, strict=True))]
        signs_of = [-1 if name == "nothing" else 1 for name in VOTERS]
        w, b = np.concatenate([np.zeros(len(values)), np.multiply(odds, signs_of)]), float(np.log(model.balance[1] / model.balance[0]))
    margin = np.array([w[rows[k]] @ signs[k] + b for k in calibrating])
    slope, shift = platt(margin, toxic[calibrating].astype(float)) if len(calibrating) else (1.0, 0.0)
    return {"features": values, "w": slope * w[: len(values)], "voters": slope * w[len(values) :], "b": slope * b + shift, "labels": model}


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve of margins, with targets drawn in from 0 and 1 by the number of examples; (1, 0) if a class is absent."""
    good, bad = int((label == 0).sum()), int((label == 1).sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(label == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        d = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(d * margin * margin).sum(), (d * margin).sum()], [(d * margin).sum(), d.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


def _margin(model: dict, places: np.ndarray, voted: np.ndarray) -> float:
    return model["w"][places].sum() + model["voters"] @ voted + model["b"]


def _decided(margin: np.ndarray, threshold: float) -> tuple[pa.Array, pa.Array]:
    """Scores and predictions."""
    p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    return pa.array(p), pa.array((p >= threshold).astype(np.int32))


def judged(voted: DataFrame, model: dict, threshold: float = THRESHOLD, named: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``voted`` (of ``evidence``) with ``score`` and ``predicted`` in place of its places and votes."""
    kept = [c for c in voted.columns if c not in ("_hits", "_votes")]
    sent = voted.sparkSession.sparkContext.broadcast({k: model[k] for k in ("w", "voters", "b")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            own, cast = (batch.column(k).to_pylist() for k in (len(kept), len(kept) + 1))
            margin = [_margin(m, np.frombuffer(o, "<i4"), np.frombuffer(v, np.uint8) - 1.0) for o, v in zip(own, cast, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *_decided(np.array(margin, float), threshold)], names=[*kept, *named])

    schema = T.StructType([*voted.select(*kept).schema.fields, T.StructField(named[0], T.DoubleType()), T.StructField(named[1], T.IntegerType())])
    return voted.select(*kept, "_hits", "_votes").mapInArrow(run, schema)


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD, named: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row, from its whole text alone; null and empty texts are scored too.

    Columns of ``docs`` with the new names, ``named``, are replaced. No shuffle; one Python pass, so that a task has one worker.
    """
    kept = docs.drop(*named)
    at_text, names = kept.columns.index(text), [*kept.columns, *named]
    sent = kept.sparkSession.sparkContext.broadcast({k: model[k] for k in ("features", "w", "voters", "b")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        telling = Telling(m["features"])
        for batch in batches:
            margin = np.empty(batch.num_rows)
            for k, t in enumerate(batch.column(at_text)):
                t = t.as_py()
                own = telling.hits(t)
                margin[k] = _margin(m, own, np.array(telling.votes(marks(t), own)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_decided(margin, threshold)], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField(named[0], T.DoubleType()), T.StructField(named[1], T.IntegerType())])
    return kept.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels are learnt only outside the held-out fold, crc32 of doc_id as text modulo ``folds``.

    A null doc_id is in no held-out fold and has no label. Repeated label rows of a document count once, as toxic if one says so. Each text is
    searched for features and marks once; what was found is written as a narrow table, from which patterns are counted and scores computed.
    """
    held = F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    values, sample = learn(docs.select("doc_id", "text"), labels.filter(~held).select("doc_id", "toxic"))
    found = written(evidence(docs.select("doc_id", held.alias("held_out"), "text"), values), "toxicity-evidence")
    return judged(found, fit_sample(values, sample, patterns(found))).select("doc_id", "held_out", "score", "predicted")
