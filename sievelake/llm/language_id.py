"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, calibrated by temperature.

Features are the runs of 1 to 3 characters of the lower-cased text, anything but letters read as one space, hashed to DIMS places; their weight is
(1 + log count) * idf, a document's vector has length 1. Document frequencies are counted over all documents that may be learnt from;
the classifier is fitted on a bounded sample of them (SAMPLE rows expected, as many of each language where there are, and LEAST of each of many
languages), four fifths to learn and one fifth to calibrate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, written
from .linear import Ftrl, softmax, temperature

DIMS, SIZES = 1 << 15, 3
SAMPLE, LEAST, EPOCHS = 4_000, 10, 4
SLICE_BYTES = 16 << 20  # of the sample, that stand in the driver's memory at once
UNKNOWN = "und"
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32)
    code = np.concatenate(([32], code[letter | np.concatenate(([True], letter[:-1]))], [32])).astype(np.uint64)
    counts, gram = np.zeros(DIMS, np.int64), np.zeros(len(code), np.uint64)
    for k in range(min(SIZES, len(code))):
        gram = gram[: len(code) - k] * np.uint64(0x100000001B3) + code[k:]
        place = (gram * _SALT[k]) >> np.uint64(64 - 15)
        counts += np.bincount(place.astype(np.int64), minlength=DIMS)
    return counts


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sparse(learner: Ftrl) -> dict:
    """The weights that are not 0, by place: those of place p are at ptr[p] to ptr[p + 1], of the languages ``lang``; and the biases."""
    place, lang, w = [], [], []
    for k in range(len(learner.z)):
        own = learner._weights(learner.z[k], learner.n[k])
        at = np.flatnonzero(own)
        place.append(at)
        lang.append(np.full(len(at), k))
        w.append(own[at])
    place, lang, w = (np.concatenate(x) for x in (place, lang, w))
    order = np.argsort(place, kind="stable")
    ptr = np.searchsorted(place[order], np.arange(DIMS + 1))
    return {"ptr": ptr, "lang": lang[order].astype(np.int32), "w": w[order].astype(np.float32), "b": learner._bias()}


def _logits(model: dict, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    first, n = model["ptr"][at], model["ptr"][at + 1] - model["ptr"][at]
    held = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
    return np.bincount(model["lang"][held], model["w"][held] * np.repeat(x, n), len(model["b"])) + model["b"]


def fit(docs: DataFrame) -> dict:
    """The model of ``docs`` (doc_id, text, lang), rows with a null lang left out: languages, idf, weights, bias and temperature.

    Every lang with a letter in its texts is learnt. While learning, the driver holds 0.5 MB a language, SLICE_BYTES of the sample, and one document more: a
    text of any length has DIMS places at most, 0.3 MB of the sample.

    No rows, or none with a letter: a model without languages. Document frequencies, of every row, and the sample come from one pass over the texts;
    rows that repeat id and text stand in the sample once.
    """
    known = docs.filter(F.col("lang").isNotNull())
    rates = known.groupBy("lang").count().collect()
    empty = {"langs": [], "idf": np.ones(DIMS), "ptr": np.zeros(DIMS + 1, np.int64), "lang": np.zeros(0, np.int32), "w": np.zeros(0, np.float32), "b": np.zeros(0), "t": 1.0}
    if not rates:
        return empty
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30))
    each = max(SAMPLE / len(rates), LEAST)
    below = docs.sparkSession.sparkContext.broadcast({r["lang"]: int(min(1.0, each / r["count"]) * (1 << 30)) for r in rates})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "drawn", "at", "counts", "place", "df"]
        df = np.zeros(DIMS, np.int64)
        docs_seen, taken = 0, set()
        for batch in batches:
            rows = []
            for text, lang, drawn in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                counts = ngram_counts(text.as_py())
                if counts is None:
                    continue
                at = np.flatnonzero(counts)
                df[at] += 1
                docs_seen += 1
                if drawn < below.value[lang] and (lang, drawn) not in taken:  # equal rows would fill the sample
                    taken.add((lang, drawn))
                    rows.append((lang, drawn, at.astype("<i4").tobytes(), counts[at].astype("<i4").tobytes()))
            if rows:
                lang, drawn, at, counts = zip(*rows, strict=True)
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(drawn, pa.int64()), pa.array(at, pa.binary()), pa.array(counts, pa.binary()), none, none], names=names)
        at = np.flatnonzero(df)
        place, n = np.concatenate((at, [DIMS])), np.concatenate((df[at], [docs_seen]))  # the place after the last counts documents
        blank = [pa.nulls(len(place), kind) for kind in (pa.string(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=names)

    made = known.select("text", "lang", drawn.alias("drawn"))
    made = written(made.mapInArrow(run, "lang string, drawn long, at binary, counts binary, place long, df long"), "language-sample")
    seen = {r.place: r.n for r in made.filter("place IS NOT NULL").groupBy("place").agg(F.sum("df").alias("n")).collect()}
    total = seen.pop(DIMS, 0)
    idf = np.full(DIMS, np.log(1 + total))
    for place, n in seen.items():
        idf[place] = np.log((1 + total) / (1 + n)) + 1
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("drawn"))
    rows = made.filter("place IS NULL").select("lang", "drawn", (F.length("at") + F.length("counts")).alias("bytes")).groupBy("lang", "drawn").agg(F.max("bytes").alias("bytes"))
    rows = rows.withColumn("turn", turn).filter(F.col("turn") <= int(2 * each)).select("lang", "drawn", "bytes").toPandas()
    if rows.empty:
        return empty
    rows = rows.sort_values(["drawn", "lang"], ignore_index=True)
    rows["k"], rows["slice"] = rows.index, rows["bytes"].cumsum() // SLICE_BYTES
    langs = sorted(set(rows["lang"]))
    number, learnt, calibrates = {lang: k for k, lang in enumerate(langs)}, set(), np.zeros(len(rows), bool)
    for k, lang in enumerate(rows["lang"]):
        calibrates[k] = k % 5 == 4 and lang in learnt
        learnt.add(lang)
    places = docs.sparkSession.createDataFrame(pa.Table.from_pandas(rows[["lang", "drawn", "k", "slice"]], preserve_index=False))
    sample = made.filter("place IS NULL").dropDuplicates(["lang", "drawn"]).join(F.broadcast(places), ["lang", "drawn"]).select("k", "slice", "at", "counts")
    sample = written(sample, "language-slices")

    def examples(calibrating: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Places, weights and language of the sampled documents, in order, read a slice at a time."""
        for part in sorted(set(rows["slice"])):
            found = sample.filter(F.col("slice") == int(part)).orderBy("k").toArrow()
            for k, at, n in zip(found["k"].to_pylist(), found["at"], found["counts"], strict=True):
                if calibrates[k] == calibrating:
                    counts = np.zeros(DIMS, np.int64)
                    counts[np.frombuffer(at.as_buffer(), "<i4")] = np.frombuffer(n.as_buffer(), "<i4")
                    yield (*_vector(counts, idf), number[rows["lang"][k]])

    learner = Ftrl(len(langs), DIMS, alpha=1.0, l1=0.02, l2=0.01)
    for _ in range(EPOCHS):
        for at, x, y in examples(False):
            target = np.zeros(len(langs))
            target[y] = 1
            learner.learn(at, x, target)
    model = {"langs": langs, "idf": idf} | _sparse(learner)
    told = [(_logits(model, at, x), y) for at, x, y in examples(True)]
    logits = np.array([t[0] for t in told]).reshape(-1, len(langs))
    return model | {"t": temperature(logits, np.array([t[1] for t in told], int))}


def identify(docs: DataFrame, model: dict, text: str = "text", named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (its calibrated probability) to every row, from the whole text alone.

    A null text, one without a letter, or any text under a model without languages gets ``und`` and 0. The model, its weights that are not 0 alone, goes
    to the executors once. Columns of ``docs`` with the new names, ``named``, are replaced.
    """
    kept = docs.drop(*named)
    at_text, names = kept.columns.index(text), [*kept.columns, *named]
    sent = kept.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            lang, score = [], []
            for text in batch.column(at_text):
                counts = ngram_counts(text.as_py()) if m["langs"] else None
                if counts is None:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, x = _vector(counts, m["idf"])
                p = softmax(_logits(m, at, x) / m["t"])
                best = int(p.argmax())
                lang.append(m["langs"][best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField(named[0], T.StringType()), T.StructField(named[1], T.DoubleType())])
    return kept.mapInArrow(run, schema)


def language_report(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns only from those outside the held-out fold.

    The fold is crc32 of doc_id as text modulo ``folds``; a null doc_id is in no held-out fold. Repeated rows are rows of their own here, each with its
    result; they count once in the sample. An empty table gives no rows. Other columns are not read.
    """
    held = F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    model = fit(docs.filter(~held).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
