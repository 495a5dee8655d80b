"""Trained operators: held-out accuracy on the given tables, edge cases, and what they must not depend on."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievelake.llm import language_id, toxicity
from sievelake.llm.common import crc_fold
from sievelake.llm.label_model import LabelModel
from sievelake.llm.linear import Ftrl, softmax, temperature

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language_accuracy(spark, tables):
    docs, _ = tables
    got = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and 0.1 < got.held_out.mean() < 0.3
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark, tables):
    docs, _ = tables
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(None, None, "en", 1.0), (1, "", None, 2.0), (2, "12 !? 3", "fr", 3.0), (3, "the and of " * 50_000, "x", 4.0), (3, "the and of " * 50_000, "x", 4.0)], "doc_id long, text string, lang_pred string, score double")
    got = language_id.identify(odd, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en"] and [r.score for r in got][:3] == [0, 0, 0]
    assert language_id.identify(odd.limit(0), model).count() == 0
    blank = language_id.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd, blank).collect()} == {("und", 0.0)}
    one = language_id.fit(docs.limit(20).select("doc_id", "text", F.lit("en").alias("lang")))
    assert {r.lang_pred for r in language_id.identify(odd, one).collect()} == {"und", "en"}


def test_language_against_loops(spark, tables):
    """Counts of n-grams, and the scores that a model gives, by plain loops over characters and dense weights."""
    docs, _ = tables
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    dense = np.zeros((len(model["langs"]), language_id.DIMS))
    for place in range(language_id.DIMS):
        for k in range(model["ptr"][place], model["ptr"][place + 1]):
            dense[model["lang"][k], place] = model["w"][k]
    odd = ["Été à Zürich -- 2024!", "a", "  x  y", "İI ıi", "ß" * 500, "one,two"]
    rows = [(k, t) for k, t in enumerate(odd + [r.text for r in docs.filter("n_chars < 400").limit(20).collect()])]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()
    for (_, text), r in zip(rows, got, strict=True):
        kept, before = " ", True
        for c in text.lower():
            if c.isalpha() or before:
                kept += c if c.isalpha() else " "
            before = c.isalpha()
        kept += " "
        counts = {}
        for n in (1, 2, 3):
            for i in range(len(kept) - n + 1):
                gram = 0
                for c in kept[i : i + n]:
                    gram = (gram * 0x100000001B3 + ord(c)) % 2**64
                place = gram * int(language_id._SALT[n - 1]) % 2**64 >> 49
                counts[place] = counts.get(place, 0) + 1
        x = {p: (1 + np.log(c)) * model["idf"][p] for p, c in counts.items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        logits = model["b"] + sum(dense[:, p] * v / norm for p, v in x.items())
        p = softmax(logits / model["t"])
        assert r.score == pytest.approx(p.max(), abs=1e-6) and r.lang_pred == model["langs"][int(p.argmax())]


def test_language_does_not_read_labels_of_the_held_out_fold(spark, tables):
    docs, _ = tables
    other = docs.withColumn("lang", F.when(crc_fold(F.col("doc_id"), 5) == 0, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("same"))
    same = language_id.language_report(docs).exceptAll(language_id.language_report(other))
    assert same.count() == 0


def test_language_learns_more_than_a_hundred(spark):
    rng = np.random.default_rng(4)
    tongues = {f"l{k:03}": ["".join(map(chr, 0x4E00 + 20 * k + rng.integers(0, 20, 4))) for _ in range(30)] for k in range(130)}
    rows = [(lang, " ".join(rng.choice(words, 40))) for k, (lang, words) in enumerate(tongues.items()) for _ in range(12 if k else 40)]
    docs = spark.createDataFrame([(n if n % 3 else None, text, lang) for n, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model["langs"] == sorted(tongues)
    got = language_id.identify(docs, model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.99 and np.mean([r.score >= 0.5 for r in got]) > 0.99


@pytest.mark.parametrize(("folder", "least", "most"), [(SF, 0.6, 0.05), ("/root/testdata/sf0.1", 0.9, 0.03)])
def test_toxicity_finds_held_out_labels(spark, folder, least, most):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_report(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    known = got.merge(labels.toPandas(), on="doc_id")
    held = known[known.held_out]
    good, bad = held[held.toxic == 0].predicted, held[held.toxic == 1].predicted
    assert good.mean() < most and bad.mean() > least


def test_toxicity_does_not_read_held_out_labels(spark, tables):
    docs, labels = tables
    other = labels.withColumn("toxic", F.when(crc_fold(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity_report(d, x) for d, x in ((docs, labels), (docs.withColumn("source", F.lit("s")).withColumn("lang", F.lit("l")), other)))
    assert a.exceptAll(b).count() == 0


def test_toxicity_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "you idiot, stupid worthless moron", 3), (2, "you idiot, stupid worthless moron", 3), (4, "fine words " * 60_000, 4)], "doc_id long, text string, score int")
    got = toxicity.toxicity_report(odd, labels.limit(0)).collect()  # nothing to learn from: the fixed voters decide
    assert len(got) == 5 and {r.predicted for r in got if r.doc_id == 2} == {1} and {r.predicted for r in got if r.doc_id != 2} == {0}
    assert toxicity.toxicity_report(odd.limit(0), labels).count() == 0
    model = toxicity.fit(docs.select("doc_id", "text"), labels.unionByName(labels).unionByName(spark.createDataFrame([(None, None, None)], labels.schema)))
    assert toxicity.score(odd, model).columns == ["doc_id", "text", "score", "predicted"]


def test_toxicity_pattern_voters_vote_everywhere(spark):
    words = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwx'[k // 100]}" for k in range(400)]
    rows = [(k, f"{w[0]}**{w[1:]}" if k % 4 == 0 else f"{w}!!" if k % 4 == 1 else w) for k, w in enumerate(words)]
    docs = spark.createDataFrame([(k, f"plain text {t}") for k, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 < 2)) for k in range(300)], "doc_id long, toxic int")
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.limit(0))):
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect() if r.doc_id >= 300}
        assert min(got[k] for k in got if k % 4 < 2) > max(got[k] for k in got if k % 4 >= 2)


def test_toxicity_reads_words_of_any_length(spark):
    long = "x" * 40 + "".join(chr(97 + k % 26) for k in range(60))
    docs = spark.createDataFrame([(k, f"plain text {chr(97 + k % 26)}{chr(97 + k // 26)}q {long if k % 3 == 0 else 'word'}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[k] == (k % 3 == 0) for k in range(200, 300))


def test_toxicity_against_loops(spark):
    """Features, votes, mined features and scores of a small table, recomputed from the texts by plain loops."""
    rng = np.random.default_rng(6)
    pool = [a + b for a in ("ab", "cd", "ef", "gh", "ij") for b in ("kl", "mn", "op", "qr", "st", "uv")]
    texts = [" ".join(rng.choice(pool, 12)) + (" zorkle" if k % 4 == 0 else "") + (" grumbler grumbly" if k % 8 == 0 else "") + (" BIG!!" if k % 5 == 0 else "") + (" you idiot" if k % 40 == 0 else "") for k in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)], "doc_id long, toxic int")
    names = {}

    def found(text):
        words, out = {w for t in set(text.lower().split()) for w in toxicity.WORDS.findall(t)}, {}
        for w in words:
            out[w, 0] = out.get((w, 0), 0) + 1
            for n in (3, 4, 5, 6, 7):
                if len(w) >= n:
                    out[w[:n], n] = out.get((w[:n], n), 0) + 1
        dense = {(w, n + 8) for (w, n), c in out.items() if n and 100 * c >= len(words)}
        return set(out) | dense

    each = [found(t) for t in texts]
    for f in set().union(*each):
        names[toxicity._keyed(f[0], f[1] & 7) | f[1] & 8] = f
    assert all({names[int(h)] for h in toxicity.features(t)} == f for t, f in zip(texts, each, strict=True))
    n, bad, total, toxic = {}, {}, len(set().union(*each)), [k % 4 == 0 for k in range(240)]
    single = toxicity.distinct(np.array([toxicity._least(toxicity.features(t)) for t in texts]))
    for k in range(240):
        for f in each[k]:
            n[f], bad[f] = n.get(f, 0) + (k in single), bad.get(f, 0) + (k in single and toxic[k])
    share = np.mean([toxic[k] for k in single])
    log = lambda m, p, q: m * np.log(p / q) if m else 0
    gain = {f: log(bad[f], bad[f] / n[f], share) + log(n[f] - bad[f], 1 - bad[f] / n[f], 1 - share) for f in n if n[f] and bad[f] / n[f] > 0.5}
    strong = {f for f, g in gain.items() if g > np.log(total) + 3}
    model = toxicity.fit(docs, labels)
    fixed = toxicity.PEOPLE | toxicity.QUALITIES | toxicity.DEEDS
    assert len(single) < 240 or {names[int(h)] for h in model["features"] if int(h) in names and names[int(h)][0] not in fixed} == strong - {(w, 0) for w in fixed}
    voters = model["voters"]
    for text, mine, row in zip(texts, each, toxicity.score(docs, model).orderBy("doc_id").collect(), strict=True):
        own = [(names.get(int(h)), w) for h, w in zip(model["features"], model["w"], strict=True) if names.get(int(h)) in mine]
        words = [f for f, _ in own if f[0] not in fixed]
        lexical = [any((w, 0) in mine for w in lexicon) for lexicon in (toxicity.PEOPLE, toxicity.QUALITIES, toxicity.DEEDS)]
        kinds = [any(f[1] in kind for f in words) for kind in ((0,), (3, 4), (5, 6, 7), (11, 12, 13, 14, 15))]
        letters = [c for c in text if c.isascii() and c.isalpha()]
        upper = sum(c.isupper() for c in letters)
        marked = ["!!" in text, "**" in text, upper >= 10 and 2 * upper > len(letters), False, "you idiot" in text]
        vote = [*lexical, *kinds, len({(f[0], f[1] & 7) for f, _ in own}) >= 3, *marked]
        margin = sum(w for _, w in own) + sum(v for v, yes in zip(voters, vote, strict=False) if yes) + model["b"] - voters[-1] * (not own and not any(marked))
        assert row.score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_toxicity_repeated_ids(spark, tables):
    docs, labels = tables
    hot = docs.unionByName(docs.filter("doc_id < 300").withColumn("doc_id", F.lit(5).cast("long"))).unionByName(docs.filter("doc_id = 7")).unionByName(docs.filter("doc_id = 7"))
    runs = [sorted(map(tuple, toxicity.toxicity_report(d, labels).collect()), key=repr) for d in (hot, hot.repartition(5))]
    assert len(runs[0]) == hot.count() and runs[0] == runs[1]


#: Votes as the label model gets them, rows; each pattern's rows are all clean, or all toxic. Patterns of a table with a tenth of its rows labelled.
CLEAN = {"0000000000000-": 31828, "00+00000000000": 4345, "00000000000+00": 1838, "00000000+0+000": 1590, "00+0+000000000": 1422, "0000+000000000": 1405, "000000000+0000": 1302, "0+00+000000000": 358, "00+000+0000000": 260, "0+000000000000": 208}
TOXIC = {"++00++0+000000": 2456, "000+++++000000": 960, "00++++++000000": 729, "++00++++000000": 364, "000+++++000+00": 247, "000+++0+000+00": 90}
MANY = [(np.array(["-0+".index(c) - 1 for c in v]), n, int(v in TOXIC)) for v, n in (CLEAN | TOXIC).items()]


def test_many_unlabelled_rows_do_not_outvote_labels():
    votes, counts, label = (np.array(x) for x in zip(*MANY, strict=True))
    m = LabelModel(np.vstack([votes, votes]), np.concatenate([np.full(len(votes), -1), label]), np.concatenate([counts, counts // 10]))
    assert ((m.posterior(votes) > 0.5) == (label == 1)).all()


def test_toxicity_of_kinds_without_lexicon_words_is_learnt():
    packed = lambda v: bytes((v + 1).tolist())
    place = lambda v: np.flatnonzero(v[3:7] == 1).astype("<i4")
    sample = [(place(v).tobytes(), packed(v), y) for v, n, y in MANY for _ in range(n // 10)]
    sample = [sample[k] for k in np.random.default_rng(4).permutation(len(sample))]
    model = toxicity.fit_sample(np.arange(4, dtype=np.uint64), sample, [Row(_votes=packed(v), n=n) for v, n, _ in MANY])
    margin = [toxicity._margin(model, place(v), v) for v, *_ in MANY]
    assert toxicity._decided(np.array(margin), 0.3)[1].to_pylist() == [y for *_, y in MANY]


def test_label_model_recovers_accuracies_and_correlation():
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.2
    vote = lambda right: np.where(rng.random(len(y)) < right, 2 * y - 1, 1 - 2 * y)
    a, b, c, d = vote(0.9), vote(0.8), vote(0.75), vote(0.7)
    copy = np.where(rng.random(len(y)) < 0.95, d, vote(0.7))
    patterns, counts = np.unique(np.column_stack([a, b, c, d, copy]), axis=0, return_counts=True)
    m = LabelModel(patterns, np.full(len(patterns), -1), counts, rounds=60)
    assert np.allclose(m.accuracy, [0.9, 0.8, 0.75, 0.7, 0.7], atol=0.07)
    assert m.correlation[3, 4] == m.correlation.max() and m.balance[1] == pytest.approx(0.2, abs=0.06)


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(2)
    learner = Ftrl(3, 200, alpha=0.5, l1=2.0)
    for _ in range(4_000):
        k = rng.integers(3)
        at = np.concatenate(([k], rng.choice(np.arange(10, 200), 8, replace=False)))
        learner.learn(at, np.ones(9), np.eye(3)[k])
    w, b = learner.model()
    assert (softmax(w[:, :3].T + b).argmax(1) == [0, 1, 2]).all() and (w[:, 10:] == 0).mean() > 0.5


def test_temperature_flattens_overconfidence():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4_000, 3))
    labels = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert temperature(5 * logits, labels) == pytest.approx(5, rel=0.2)
    assert temperature(logits[:0], labels[:0]) == 1.0


def test_languages_in_slices(spark, monkeypatch):
    """A sample that is read a document at a time gives the model that it gives whole; long texts and unlike languages."""
    rng = random.Random(6)
    words = {"xx": ["aba", "bab", "abba"], "yy": ["cec", "ece", "cecce"], "zz": ["éü", "üé", "ß"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20_000 if k == 7 else 12)), lang) for k, lang in enumerate(list(words) * 6)]
    docs = spark.createDataFrame([*rows, (1000, None, "xx"), (1001, "12", "yy"), (1002, "aba", None)], "doc_id long, text string, lang string")
    whole = language_id.fit(docs)
    monkeypatch.setattr(language_id, "SLICE_BYTES", 1)
    sliced = language_id.fit(docs)
    assert whole["langs"] == sliced["langs"] == ["xx", "yy", "zz"] and whole["t"] == sliced["t"]
    assert all(np.array_equal(whole[k], sliced[k]) for k in ("idf", "ptr", "lang", "w", "b"))
