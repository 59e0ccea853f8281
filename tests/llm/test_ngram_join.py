import random

import duckdb
import pytest

from sightline.llm import ngram_join
from sightline.llm.common import connected_components
from sightline.llm.ngram_join import OP10_SQL, jaccard_components, keep_one_of_each_group, op10_ngram_join

SF = "/root/testdata/sf0.001"


def sets_of(text, width):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return set()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) if k == width else tuple(words) for i in range(len(words) - k + 1)}


def brute(texts, width, percent):
    sets = {d: sets_of(t, width) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in texts}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_op10_on_whole_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert as_dict(op10_ngram_join(spark, SF)) == brute(texts, 4, 85)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 150, 300]))
        for _ in range(rng.choice([1, 2, 6, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 60, len(base) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary).upper()
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice([2, 10, 80]))) for _ in range(60)]
    return {i * 7 % 100003: t for i, t in enumerate(texts)} | {200000: None, 200001: "", 200002: " \t\n", 200003: "one", 200004: "ONE"}


@pytest.mark.parametrize(("width", "percent", "bucket", "block"), [(4, 85, 24, 1024), (5, 80, 3, 16)])
def test_near_groups_against_brute_force(spark, monkeypatch, width, percent, bucket, block):
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    texts = planted(width)
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, n string")
    got = as_dict(jaccard_components(docs, width, percent))
    want = brute(texts, width, percent)
    assert got == want
    kept = {r.doc_id for r in keep_one_of_each_group(docs, width, percent).collect()}
    assert kept == {c for _, c in want.values()}


def test_op10_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {d: (n, c) for d, n, c in duck.execute(OP10_SQL).fetchall()}
    assert as_dict(op10_ngram_join(spark, SF)) == want


def test_templated_documents_form_no_large_candidate_groups(spark, monkeypatch):
    """Documents of 6 out of 60 pooled sentences: large buckets, but hardly a pair passes all filters."""
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(60)]
    texts = {i: " ".join(rng.sample(pool, 6)) for i in range(800)}
    seen, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, sets, percent: seen.append(pairs) or verified(pairs, sets, percent))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert as_dict(jaccard_components(docs)) == brute(texts, 5, 80)
    stars, pairs = seen
    assert stars.count() < len(texts) and pairs.count() < len(texts)  # before bitmaps of whole sets and verification


@pytest.mark.parametrize("dense", [0, 16])
def test_large_groups_of_near_copies_and_outsiders(spark, monkeypatch, dense):
    """Copies that their leader connects meet no more; chains and outsiders, in blocks of few documents, are still found."""
    for name, value in (("BLOCK_DOCS", 32), ("BUCKET", 8), ("DENSE", dense)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(400):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    chain = list(base)
    for i in range(400, 460):  # each near the one before, the last far from the first
        for _ in range(2):
            chain[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        texts[i] = " ".join(chain)
    far = base[:150] + [f"z{i}" for i in range(50)]
    for i in range(460, 500):
        copy = list(far)
        copy[rng.randrange(200)] = f"q{i}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = as_dict(jaccard_components(docs))
    assert got == brute(texts, 5, 80) and len({c for _, c in got.values()}) > 1


def test_very_long_texts_and_exact_similarity(spark):
    long = " ".join(f"v{i}" for i in range(300_000))
    texts = {1: long, 2: long + " end", 3: "z" * 2_000_000, 4: " " * 2_000_000, 5: " ".join(f"a{i}" for i in range(84)), 6: " ".join([*(f"a{i}" for i in range(84)), *(f"b{i}" for i in range(20))])}
    got = as_dict(jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert got == brute(texts, 5, 80) and got[6][1] == 5  # 80 of 100 shingles


def test_empty_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert rows == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3)]
    assert jaccard_components(docs.limit(0)).count() == 0
    large = spark.createDataFrame([(2**62 + 1, "a b c d e f"), (None, "x"), (2**62 + 3, "A b c d e f")], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in jaccard_components(large).collect()} == {(2**62 + 1, 2**62 + 1), (2**62 + 3, 2**62 + 1), (None, None)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (3, 3), (9, 7)] + [(1000, 1001 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5, 9: 5, 3: 3, **{1000 + i: 1000 for i in range(51)}}
