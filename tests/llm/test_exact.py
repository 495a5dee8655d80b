"""Operators with an exact answer, against brute force on small tables full of edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelake.llm import fingerprint, mixing, near_dup, packing, token_count, token_output, topk, url_filter
from sievelake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, block int, target string"


def documents(spark, rows):
    """Rows of (doc_id, text, source); other columns clash with names that operators use."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 0.5, 1, "x") for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "b", "Don't", "'s", "<|endoftext|>", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "²", "½", "é", "日本", "🎉", "1", "23", "!!", "_", "\r\n", "x" * 50]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", "\n ", "foo\n ", " ", "a" * 20_000, "the cat " * 3_000]


def test_token_counts(spark, odd_texts):
    library = Tokenizer.from_file(BPE)
    df = documents(spark, [(k, t, "s") for k, t in enumerate(odd_texts)] + [(1, None, None), (None, "x y", None), (5, odd_texts[5], "s")])
    got = token_count.token_report(df, BPE).collect()
    assert len(got) == len(odd_texts) + 3
    for r in got:
        t = "x y" if r.doc_id is None else odd_texts[r.doc_id]
        if not (r.doc_id == 1 and r.n_bytes == 0):
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)), t[:50]
        assert r.over_limit == (r.n_tokens > 512)
    assert token_count.token_report(df.limit(0), BPE).count() == 0
    assert token_count.count_tokens(df, BPE).columns == [*df.columns, "n_bytes", "n_tokens"]


def test_token_files(spark, odd_texts, tmp_path):
    library = Tokenizer.from_file(BPE)
    rows = [(k * 7 - 50, t, "s") for k, t in enumerate(odd_texts)] + [(-1000, None, None)]
    random.Random(1).shuffle(rows)
    path = f"file://{tmp_path}/ids"
    got = {r.doc_id: r for r in token_output.token_file_report(documents(spark, rows), BPE, path).collect()}
    start = 0
    for d, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    store, folder = token_output._store(path)
    dictionary = (tmp_path / "ids" / "dictionary.zstd").read_bytes()
    name = token_output.shards(spark, path).first()["name"]
    shard = token_output.Shard(store, f"{folder}/{name}", dictionary)
    assert len(shard.read(0, 1)[0]) == shard.index["ids"][0]
    with pytest.raises(ValueError, match="another dictionary"):
        token_output.Shard(store, f"{folder}/{name}", dictionary + b"x")
    assert token_output.token_file_report(documents(spark, []), BPE).count() == 0
    twice = token_output.token_file_report(documents(spark, [(1, "a", "s"), (1, "a", "s"), (None, "b", "s")]), BPE).collect()
    assert [r.start for r in sorted(twice, key=lambda r: r.start)] == [0, 2, 4] and {r.doc_id for r in twice} == {1, None}


def test_ids_of_known_pre_tokens_spare_the_pattern(monkeypatch):
    library, rng = Tokenizer.from_file(BPE), random.Random(9)
    want = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    parts = ["\n", "\n\n", " ", "'", "'s", "'ll", "12", "x", "Straße", "é", ",", ".", "|", "@", "word", "\u024f"]
    known = ["one two.\nthree 4567|x@y.z don't 's\n\nend ", *("a" + "".join(w if w != " " else " b" for w in rng.choices(parts, k=30)) for _ in range(500))]
    odd = ["".join(rng.choices([*parts, "\t", "\r\n", "\u00a0", "\u00b5", "ω", "²", "\x1c", "🙂"], k=30)) for _ in range(500)]
    encoder = token_output.IdEncoder(BPE)
    assert all(encoder.encode(t) == want(t) for t in known + odd)
    monkeypatch.setattr(token_output.IdEncoder, "whole", None)
    encoder = token_output.IdEncoder(BPE)
    assert encoder.encode("one two.\nthree 4567|x@y.z don't 's\n\nend") == want("one two.\nthree 4567|x@y.z don't 's\n\nend")


def brute_mix(rows):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, total, target = set(sources), sum(sizes), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * size[s]}
        if not over:
            return size, target | share
        for s in over:
            target[s] = 3.0 * size[s]
            total -= 3 * size[s]
        left -= over
    return size, target


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "\U0001f600", "\uffee", None, ""][: rng.randint(1, 7)]
    rows = [(k, rng.choice([None, "", "x " * rng.randint(0, 60 if k % 9 else 900)]), rng.choice(names)) for k in range(300)]
    size, target = brute_mix(rows)
    df = documents(spark, rows).withColumn("size", mixing.word_count(F.col("text")))
    sized = df.select("doc_id", "source", "size")
    targets = mixing.water_fill(mixing.ranked_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    got = mixing.mix(sized, targets).collect()
    assert len(got) == 300
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.copies * r["size"] + r.part
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(sized.repartition(3), targets).collect()), key=str)
    mixed = mixing.repeated(mixing.mix(df.select("doc_id", "source", "text", "n_chars", "size"), targets, narrow=sized), ["doc_id", "text", "source", "n_chars"])
    assert {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect() if r.n} == {s: n for s, n in taken.items() if n}


def test_mixing_of_null_ids_and_clashing_columns(spark):
    """A third of the rows has no id; columns are named as those that a mix adds or uses."""
    rng = random.Random(21)
    rows = [(None if k % 3 == 0 else k, rng.choice("ab"), rng.randint(0, 4), f"t{k}", "old", 1.5, k) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, _key string, target string, _other0 double, _bucket int")
    targets = mixing.water_fill(mixing.ranked_weights(df.groupBy("source").agg(F.sum("size").alias("source_size"))))
    got = mixing.mix(df, targets)
    assert got.columns == ["doc_id", "source", "size", "_key", "_other0", "_bucket", "source_size", "target", "copies", "part", "taken"]
    rows_got = got.collect()
    assert len(rows_got) == 300 and {(r._key, r._bucket) for r in rows_got} == {(f"t{k}", k) for k in range(300)}
    size, want = ({r.source: r[c] for r in targets.collect()} for c in ("source_size", "target"))
    for s in "ab":
        assert abs(sum(r.taken for r in rows_got if r.source == s) - want[s]) <= 1 and {r.source_size for r in rows_got if r.source == s} == {size[s]}
    assert sorted(map(tuple, rows_got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7), targets).collect()), key=str)


def test_mixing_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, size long")
    targets = mixing.water_fill(mixing.ranked_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    assert mixing.mix(sized, targets).count() == 0
    blank = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, None, 0)], sized.schema)
    targets = mixing.water_fill(mixing.ranked_weights(blank.groupBy("source").agg(F.sum("size").alias("source_size"))))
    assert [r.taken for r in mixing.mix(blank, targets).collect()] == [0, 0, 0]


def test_urls(spark):
    urls = ["http://A.Example.COM/en/1", "https://www.example.com/en/x?y", "http://b.net/es/", "http://b.net/es", "http://b.net/fr/#q", "http://x.com", "http://x.com/", "http://xcom/", "http://notexample.com/en/", "ftp://é.net/de/", "no scheme", "", None, "a://b://c/", "://net/fr/1", "http://u@n.com:80/p"] * 3
    df = spark.createDataFrame([(k, u, "h", "rule") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(urls)
    by_url = {}
    for r in got:
        u = urls[r.page_id] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert by_url.setdefault(urls[r.page_id], (r.verdict, r.score)) == (r.verdict, r.score)
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_model_is_the_interpolated_estimate(spark):
    urls = [("http://good.com/a1", "allow"), ("http://good.com/b", "allow"), ("http://bad.net/zz", "block"), ("http://bad.net/9", "block")]
    model = {r.cell: r.gain for r in url_filter.train(spark.createDataFrame(urls, "url string, ruled string")).collect()}
    alphabet = "abcdefghijklmnopqrstuvwxyz0" + url_filter.MARKS + "~"

    def estimate(side, context, c):
        texts = ["~~" + re.sub("[0-9]", "0", u.split("://")[1]) for u, v in urls if v == side]
        p = 1 / 38
        for order in range(3):
            ctx = context[2 - order :]
            after = [t[i] for t in texts for i in range(2, len(t)) if t[i - order : i] == ctx]
            if after:
                p = (after.count(c) + len(set(after)) * p) / (len(after) + len(set(after)))
        return p

    for text in ("~~g", "goo", "/a0", "xyz", "t/z"):
        cell = sum(alphabet.index(ch) * 38 ** (2 - k) for k, ch in enumerate(text))
        want = np.log(estimate("allow", text[:2], text[2])) - np.log(estimate("block", text[:2], text[2]))
        assert model[cell] == pytest.approx(want)


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 120))] for _ in range(12)]
    texts = []
    for _ in range(500):
        w = list(rng.choice(base[:2] if rng.random() < 0.5 else base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 5000)}"
        texts.append(" ".join(w))
    texts += ["", None, " ", "one", "One", "one two three", "one  two\nthree", "É a b c", "é a b c", "x " * 30_000, "x " * 20_000] + texts[:30]
    n, want = brute_components(texts, 4, 80)
    df = documents(spark, [(k, t, None) for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    assert len(got) == len(texts)
    for k, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (n[k], want[k], want[k] == k)


def test_near_duplicate_edges(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    rows = [(7, "a b c d e", "s"), (7, "a b c d e", "s"), (None, "a b c d e", "s"), (3, None, None), (None, None, None), (7, "q r s t", None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (3, 0, 3, True), (None, 0, None, True), (7, 1, 7, True)], key=str)


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    test_near_duplicates(spark)


def test_drifting_copies_are_one_component(spark):
    """Texts of which only neighbours are alike."""
    words = [f"w{k}" for k in range(700)]
    texts = [" ".join(words[3 * k : 3 * k + 150]) for k in random.Random(3).sample(range(180), 180)]
    got = near_dup.near_duplicates(documents(spark, [(None if k % 7 == 6 else k, t, None) for k, t in enumerate(texts)])).collect()
    assert len(got) == 180 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_tiles_link_what_pairs_would(spark, monkeypatch):
    """One bucket of all classes, in blocks of a few, but for pairs of one component."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "HELD", 900)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(700)]
    texts = [" ".join(words[3 * k : 3 * k + rng.randint(140, 150)]) for k in rng.sample(range(180), 70)]
    classes = near_dup.sets_of(documents(spark, [(k, t, None) for k, t in enumerate(texts)]), 4).withColumnRenamed("doc_id", "cid").persist()
    sets = [near_dup.shingle_set(t, 4) for t in texts]
    shingles = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "cid long, shingles binary")
    held = sum(map(len, sets))
    for part in (1, 3):
        component = F.when(F.col("cid") % part == 0, F.col("cid")).otherwise(-1)  # those of -1 are known to be one
        buckets = classes.select(F.lit(5).cast("long").alias("key"), F.lit(0).alias("band"), F.lit(70).alias("n"), F.lit(held).alias("held"), "cid", component.alias("component"))
        links = {tuple(sorted(r)) for r in near_dup._tile_links(buckets, classes, shingles, 80, 1e-9).collect()}
        of = [k if k % part == 0 else -1 for k in range(70)]
        pairs = {(i, j) for i in range(70) for j in range(i + 1, 70) if of[i] != of[j] and near_dup.alike(sets[i], sets[j], 80)}
        assert links <= pairs and reach(70, links) == reach(70, pairs) and len(links) > 20


def test_huge_buckets_are_dealt_again(spark, monkeypatch):
    """By a second band: components stay as they are, and unlike classes of one bucket leave no rows for blocks."""
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2**32, (3_000, near_dup.HASHES), dtype=np.uint32)
    sig[:, : near_dup.ROWS] = 7  # all share band 0
    sig[:40, 8:12] = sig[0, 8:12]  # some a later band too
    classes = spark.createDataFrame([(k, bytearray(s.tobytes()), 50) for k, s in enumerate(sig)], "cid long, sig binary, n_shingles long")
    cid = F.col("cid")
    buckets = classes.select(F.lit(5).cast("long").alias("key"), F.lit(0).alias("band"), F.lit(3_000).alias("n"), F.lit(0).alias("rep"), "cid", cid.alias("component"), F.lit(150_000).alias("held"))
    finer = near_dup._finer(buckets, classes)
    assert finer.columns == buckets.columns and sorted(r.cid for r in finer.collect()) == list(range(40)) and finer.first().n == 40
    assert near_dup._finer(buckets.withColumn("component", F.lit(1)), classes).count() == 0
    monkeypatch.setattr(near_dup, "SMALL", 2)
    near = near_dup.near_duplicates
    monkeypatch.setattr(near_dup, "near_duplicates", lambda df: near(df, fine=3))
    test_near_duplicates(spark)


def reach(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}


def test_pruning_misses_no_more_than_asked():
    rng = np.random.default_rng(0)
    need = near_dup.least_equal(80, 1e-9)
    a = rng.integers(0, 2**32, (20_000, near_dup.HASHES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    assert len(near_dup.survivors(a, b, need)) == 20_000
    b = np.where(rng.random(a.shape) < 0.3, a, a + 1)
    assert len(near_dup.survivors(a, b, need)) < 50


@pytest.mark.parametrize("big", [1.0, 1e12])
def test_top_k(spark, monkeypatch, big):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "LONGEST", 60)
    monkeypatch.setattr(topk, "QUERIES", (4, 5))
    monkeypatch.setattr(topk, "PENDING", 50)
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, 0.5, 0.26, 0.0]) * rng.random() * big for _ in range(6)]) for k in range(200)]
    rows += [(300 + k, [0.5] * 6) for k in range(30)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")]), (1060, [float("inf")]), (None, [1.0]), (1080, []), (1100, [2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, score int")
    sound = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in sound:
        if q % 20 == 0:
            clipped = lambda b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))  # noqa: B023, E731
            scored = sorted((-clipped(b), i) for i, b in sound if i != q)[:20]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_skips_blocks_of_unlike_vectors(spark, monkeypatch):
    """Vectors in groups far from each other, dealt over the ids: most blocks are never visited, and the result is that of all pairs."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    x = np.floor(64 * (centres[rng.integers(0, 12, 2_400)] + rng.normal(size=(2_400, 16)) * 0.1)) / 64
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {tuple(r) for r in topk.top_k(df, seen=seen).collect()}
    scores = (64 * x[::20]) @ (64 * x).T
    scores[np.arange(120), np.arange(0, 2_400, 20)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(2_400), scores.shape), -scores), axis=1)[:, :20]
    assert got == {(20 * q, n + 1, int(i), int(scores[q, i])) for q, line in enumerate(order) for n, i in enumerate(line)}
    assert 0 < seen[0].value < 0.4 * seen[1].value


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = {k: " ".join(f"W{rng.randint(0, 900)}" for _ in range(rng.randint(0, 300))) for k in range(0, 120, 2)} | {1: None, 3: "", 5: "éß🎉" * 50, 7: "one two", 9: "One two", 11: "x y " * 20_000}
    got = {r.doc_id: r for r in fingerprint.fingerprint_report(documents(spark, [(k, t, None) for k, t in texts.items()])).collect()}
    order = sorted(texts, reverse=True)

    def sketch(print_):
        return {print_[i : i + 16] for i in range(0, len(print_), 16)}

    def hashes(text):
        """The kept hashes of a text by a loop, as hexadecimal text: Spark hashes a shingle word by word, each with the hash before as its seed."""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text)]
        found = set()
        for i in range(max(len(words) - 4, 1) if words else 0):
            h = 42
            for w in words[i : i + 5]:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            found.add(h - (h >> 63 << 64))
        kept = {h for h in found if h < -(2**63) + 2**64 // fingerprint.SCALE} or ({min(found)} if found else set())
        return {f"{h % 2**64:016x}" for h in kept}

    for k, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (sketch(x) for x in (r.fingerprint, r.edited_fingerprint, got[order[(k + 1) % len(order)]].fingerprint))
        assert (a, b) == (hashes(t), hashes(edited))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        assert bool(a) == bool(t.strip())
    assert got[7].fingerprint == got[9].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > 0.35


def test_fingerprint_edges(spark):
    assert fingerprint.fingerprint_report(documents(spark, [])).count() == 0
    (one,) = fingerprint.fingerprint_report(documents(spark, [(1, "abcdef", None)])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    got = fingerprint.fingerprint_report(documents(spark, [(2, "abcdef", None), (2, "abcdef", None), (None, "xyz", None)])).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(x).hexdigest() for x in (b"abcdab", b"abcdxy", b"xya"))


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(8)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(8_000)]
    df = spark.createDataFrame([(" ".join(long[:1_000]), " ".join(long), " ".join(long[500:]))], "a string, b string, c string")
    s = df.select(*[fingerprint.sketch(F.col(c)).alias(c) for c in "abc"])
    r = s.select(fingerprint.containment(F.col("a"), F.col("b")).alias("ab"), fingerprint.containment(F.col("b"), F.col("a")).alias("ba"), fingerprint.merge(F.col("a"), F.col("c")).alias("m"), "b").first()
    assert r.ab == 1.0 and r.ba == pytest.approx(0.125, abs=0.04) and set(r.b) - set(r.m) == set() or len(set(r.b) - set(r.m)) <= 2


def test_packing(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([0, 3, 20, 40, 250]))), rng.choice(["a", "b", "c", None])) for k in range(200)] + [(500, None, "a"), (None, "x y", "b"), (3, "copy me now", "a"), (4, "Copy  me NOW", "b"), (4, "Copy  me NOW", "c")]
    df = documents(spark, rows)
    got = packing.pack(df, capacity=100).collect()
    assert sum(r.n_words for r in got) == sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r)
    source = {k: s for k, _, s in rows if k not in (3, 4)}
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: (r.bin_offset, r.n_words)):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= 100
        used = [source[r.doc_id] for r in members if r.doc_id in source and r.n_words]
        assert len(used) == len(set(used))
    copies = [r.bin_id for r in got if r.doc_id in (3, 4) and r.n_words == 3]
    assert len(copies) >= 3 and len(set(copies)) == len(copies)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, packing.pack(df.repartition(3), capacity=100).collect()), key=str)
    assert packing.pack(df.limit(0)).count() == 0
    texts = packing.packed_texts(documents(spark, rows[:100]), packing.pack(documents(spark, rows[:100]), capacity=100))
    assert texts.agg(F.max(mixing.word_count(F.col("text")))).first()[0] <= 100


def test_bins_hold_every_word_of_repeated_ids(spark):
    """As after a mix: ids and whole rows repeat, and a copy may be of part of a text."""
    rows = [(k % 7 or None, " ".join(f"w{k}x{n}" for n in range(9 * k % 41)), "ab"[k % 2]) for k in range(60)]
    rows += rows[:20] + [(i, t[: len(t) // 2], s) for i, t, s in rows[20:40]]
    df = documents(spark, rows)
    got = packing.packed_texts(df, packing.pack(df, capacity=50)).collect()
    assert sorted(w for r in got for w in r.text.split()) == sorted(w for _, t, _ in rows for w in t.split())


def test_bins_are_the_tightest_compatible():
    rng = random.Random(10)
    rows = sorted(((rng.randint(1, 60), rng.randint(0, 3), rng.randint(0, 40)) for _ in range(400)), reverse=True)
    shard = packing.Shard(100)
    for n, s, c in rows:
        fit = [b for b in range(len(shard.left)) if shard.left[b] >= n and not shard.sources[b] >> s & 1 and not shard.clusters[b] >> c & 1]
        least, before = min((shard.left[b] for b in fit), default=None), len(shard.left)
        b, offset = shard.place(n, 1 << s, 1 << c)
        assert (b in fit and shard.left[b] == least - n) if fit else b == before
        assert offset == 100 - n - shard.left[b]
