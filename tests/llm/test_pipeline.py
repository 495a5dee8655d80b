"""The pipeline's stages: columns, decisions, and their agreement with the operators."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sievelake.llm import near_dup, packing
from sievelake.llm.common import scratch_paths, written
from sievelake.llm.mixing import word_count

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"start": docs}
    for name, stage in pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, SF), "stage")
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "mixing", "packing"]
    for name, _ in pipeline.STAGES[:-1]:
        assert stages[name].dtypes == stages["start"].dtypes


def test_filters_keep_clean_documents(stages):
    n = {k: v.count() for k, v in stages.items()}
    assert n["start"] >= n["toxicity"] > 0.8 * n["start"] and n["language_id"] >= 0.98 * n["toxicity"]
    assert stages["toxicity"].exceptAll(stages["start"]).count() == 0


def test_one_document_of_each_group_stays(stages):
    rows = stages["language_id"].collect()
    sets = {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == [d for d in ids if find(d) == d]


def test_mix_and_packing_lose_nothing(stages):
    words = lambda df: df.agg(F.sum(word_count(F.col("text")))).first()[0]
    before, after = words(stages["near_dedup"]), words(stages["mixing"])
    assert abs(before - after) <= 20
    assert stages["packing"].agg(F.sum("n_words")).first()[0] == after
    assert stages["mixing"].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_bins_hold_the_mix(stages):
    texts = packing.packed_texts(stages["mixing"], stages["packing"]).collect()
    want = sorted(w for r in stages["mixing"].collect() for w in WORD.findall(r.text or ""))
    assert sorted(w for r in texts for w in WORD.findall(r.text)) == want


def test_run_is_the_stages(spark, stages):
    before = set(scratch_paths())
    assert pipeline.run(spark, SF).exceptAll(stages["packing"]).count() == 0
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch_paths() if p not in before] == ["mixing", "pack-sizes"]


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "one", None, None, 3), (10**9 + 2, "word " * 30_000, "en", "s", 150_000)], docs.schema)
    mixed = docs.limit(40).unionByName(odd).unionByName(odd).withColumn("_gone", F.lit(1)).withColumn("score", F.lit("x")).withColumn("size", F.lit(2)).withColumn("target", F.lit(2))
    empty = mixed.limit(0)
    for start in (written(mixed, "odd"), written(empty, "odd")):
        d = start
        for _, stage in pipeline.STAGES[:-1]:
            d = written(stage(spark, d, SF), "stage")
            assert d.columns == start.columns
        assert pipeline.STAGES[-1][1](spark, d, SF).count() >= 0


def test_copies_of_a_row_become_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "A b c d e f g", "en", "s", 13), (3, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and near_dup.near_duplicates(docs).count() == 5


def test_documents_stay_where_no_language_can_be_learnt(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "é"), (3, "12 !?"), (4, ""), (5, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in pipeline.keep_known_languages(spark, docs, SF).collect()) == [1, 2]


def test_one_row_of_each_group_stays_whatever_its_doc_id(spark):
    words = [f"w{k}" for k in range(60)]
    a, near, b = " ".join(words), " ".join(words[:59]), " ".join(reversed(words))
    rows = [(None, a), (None, near), (7, b), (7, b + " end"), (None, b), (8, "alone here"), (None, "only this"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert len(got) == 5 and {(8, "alone here"), (None, "only this"), (None, None)} <= set(got)
    assert sum(d == 7 for d, _ in got) == 1 and sum(t in (a, near) for _, t in got) == 1
