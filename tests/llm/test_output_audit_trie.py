"""Token files and their index, the audit of filters, and the trie of conversations, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sightline.llm import prefix_trie as P
from sightline.llm import queries as Q
from sightline.llm import token_output as O
from sightline.llm.filter_audit import filter_audit, op12_filter_audit

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def same_as_sql(df, sql, folder=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted(found.fetchall(), key=key)


# --- token files ---


def expected_tokens(rows):
    t, at, out = Tokenizer.from_file(BPE), 0, []
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_the_query_gives_what_the_tokenizer_gives(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    assert sorted(tuple(r) for r in Q.QUERIES["op11_token_output"](spark, SF).collect()) == expected_tokens(rows)


@pytest.mark.parametrize("width", [2, 4])
def test_many_shards_repeated_and_missing_keys(spark, tmp_path, width):
    random.seed(width)
    words = ["tree", "", "ünïcödé", "0!!\n\n", "a" * 300, "<|endoftext|>", "plain words here", "\U0001f600"]
    rows = [(i * 7 - 50, " ".join(random.choices(words, k=random.randint(0, 40)))) for i in range(120)]
    rows += [(21, f"the same id {i % 3}") for i in range(90)] + [(None, "no id")] * 40 + [(None, None), (5000, "x " * 20000)]
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, _u int, shard string").repartition(5)
    folder = str(tmp_path / "out")
    O.write_tokens(docs, folder, BPE, width=width, shard_bytes=2000)
    shards = spark.read.parquet(f"{folder}/manifest").count()
    assert shards > 10
    keys = [(d, c) for d, n in pd.Series([d for d, _ in rows]).value_counts(dropna=False).items() for c in range(n)]
    keys = [(None if pd.isna(d) else int(d), c) for d, c in keys] + [(-2, 0), (21, 500), (None, 41)]
    got = O.read_tokens(spark, folder, spark.createDataFrame(keys, "doc_id long, copy long"), width=width, keep_ids=True).collect()
    assert len(got) == len(rows)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in in_order] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(in_order)) and in_order[0].start == 0
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    t = Tokenizer.from_file(BPE)
    want = sorted((d is not None, d or 0, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, x in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    # Raw files: the ids and nothing else, shard after shard.
    files = spark.read.format("binaryFile").load(f"{folder}/data").where("kind = 0").orderBy("shard").collect()
    assert len(files) == shards
    assert b"".join(f.content for f in files) == b"".join(np.frombuffer(r.ids, "<u4").astype(f"<u{width}").tobytes() for r in in_order)


def test_no_documents_give_no_ids(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    O.write_tokens(docs, str(tmp_path / "none"), BPE)
    assert O.listed_keys(spark, str(tmp_path / "none")).count() == 0
    assert O.read_tokens(spark, str(tmp_path / "none"), spark.createDataFrame([(1, 0)], "doc_id long, copy long")).count() == 0


def test_an_end_that_the_files_cannot_hold(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="ASCII"):
        O.write_tokens(docs, str(tmp_path / "x"), BPE, end_id=50256)
    O.write_tokens(docs, str(tmp_path / "y"), BPE, end_id=50256, width=4)
    row = O.read_tokens(spark, str(tmp_path / "y"), spark.createDataFrame([(1, 0)], "doc_id long, copy long"), width=4, keep_ids=True).first()
    assert np.frombuffer(row.ids, "<u4").tolist()[-1] == 50256


@pytest.mark.parametrize("n", [1, 2, 7, 500, 8192, 20000])
def test_the_hash_is_minimal_and_perfect(n):
    rows = pd.DataFrame({"known": True, "doc_id": np.random.default_rng(n).permutation(n * 3)[:n], "copy": 0})
    buckets = -(-n // O.BUCKET)
    a, b, _ = O.key_hashes(rows)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    shift = O.displacements(bucket, b, n, buckets)
    assert sorted(O.slots(b, shift[bucket], n)) == list(range(n))


# --- audit of filters ---


def audit_by_hand(docs, labels):
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, s, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and t in first and first[t] < d}
        rows.append((s or "", fails, d in good, d in toxic))
    out, removed = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                hit = [r for r in left if r[1][x]]
                kept = [r for r in left if not r[1][x]]
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                out[part, order, step] = [len(kept), len(hit), sum(r[1][x] for r in gone), alone, sum(r[2] for r in hit), sum(r[3] for r in hit)]
                removed[part, x] = removed.get((part, x), 0) + len(hit)
                gone, left = gone + hit, kept
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_hand(spark):
    random.seed(5)
    texts = [None, "", "Few words", "a " * 60, " ".join(f"w{i}" for i in range(55)), "LOUD " * 51, "cost $5 " + " ".join(f"w{i}" for i in range(60)), "ä ö ü\x0b" * 30, "x" * 100_000 + " | y"]
    docs = [(random.choice([None, *range(40)]), random.choice([None, "", "p", "q"]), random.choice(texts)) for _ in range(300)]
    labels = [(i % 30, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(45)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, text string, mask int, _bits int")
    got = filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()} == audit_by_hand(docs, labels)
    assert filter_audit(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_query(spark):
    same_as_sql(op12_filter_audit(spark, SF), Q.ORACLE_SQL["op12_filter_audit"])


# --- trie ---


def trie_by_hand(convs):
    """convs: {conv_id: [(role, text), ...]}"""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)
        size = lambda k: len(k[-1][1].encode()) if k else 0
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(key))))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in under), sum(map(leaf, under)),
            sum((len(nodes[k]) - 1) * size(k) for k in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made_conversations(seed):
    random.seed(seed)
    rows = []
    for c in [*range(60), -3, -7, 1000]:
        n = random.choice([0, 1, 2, 3, 5, 9, 12])
        for t in range(n):
            text = random.choice(["hello", "", None, "ünï", f"own {c}"]) if t > random.choice([1, 3, 9]) else random.choice(["same", "start"])
            rows.append((c, random.choice([t, t, t, None]), random.choice(["user", "user", None]), text))
    rows += [(77, i, "user", f"long {i // 2}") for i in range(700)] + [(78, i, "user", f"long {i // 2}") for i in range(650)] + [(None, 1, "user", "no one's")]
    return rows


def by_conversation(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    return {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)] for c in {r[0] for r in rows} - {None}}


@pytest.mark.parametrize("most", [P.MOST, 64])
def test_trie_by_hand(spark, monkeypatch, most):
    """With a sketch so small that most estimates are too large, and blocks that cut conversations."""
    monkeypatch.setattr(P, "MOST", most)
    monkeypatch.setattr(P, "PER_PREFIX", 4 if most == P.MOST else 0)
    monkeypatch.setattr(P, "CHUNK", 7)
    rows = [r for r in made_conversations(most) if r[0] is None or not (76 < r[0] < 79) or r[1] < 60]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, block int, k1 int")
    got = sorted((tuple(r) for r in P.conversation_trie(frame).collect()), key=str)
    assert got == trie_by_hand(by_conversation(rows))


def test_trie_of_rebuilt_conversations(spark, tmp_path):
    rows = made_conversations(3)
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = P.op13_prefix_trie(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(Q.ORACLE_SQL["op13_prefix_trie"])
    names = [x[0] for x in found.description]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)
    convs, before = by_conversation(rows), by_conversation(rows)
    for c in convs:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        convs[c] = before.get(base, [])[:h] + before[c][h:]
    small = {c: t for c, t in convs.items() if len(t) < 100}
    want = {x[0:2]: x for x in trie_by_hand(small)}
    have = [tuple(r) for r in got.where("depth > 0").collect() if r.conv_id in small]
    assert have and all(want[r[0:2]][4:6] == r[4:6] for r in have)


def test_trie_query_and_no_conversations(spark):
    same_as_sql(Q.QUERIES["op13_prefix_trie"](spark, SF), Q.ORACLE_SQL["op13_prefix_trie"])
    assert P.conversation_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
