import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from churnlens.llm import simhash_dedup as S
from churnlens.llm.components import connected_components
from corpus_docs import make_docs


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    fps = np.array(fps, dtype=np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parent[max(root(x), root(y))] = min(root(x), root(y))
    return [root(x) for x in range(len(fps))]


def test_fingerprint(monkeypatch):
    r = random.Random(3)
    for segment in (7, 100, S.SEGMENT):
        monkeypatch.setattr(S, "SEGMENT", segment)
        for _ in range(300):
            t = "".join(r.choice("abcÉ İ \n\t\x0b Z") for _ in range(r.randrange(80)))
            assert S.fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_index_finds_every_link(spark, monkeypatch):
    rng = np.random.default_rng(0)
    fps = list(map(int, rng.integers(0, 2 ** 63, 150, dtype=np.uint64)))
    for _ in range(1500):  # chains and dense balls
        x = fps[int(rng.integers(len(fps)))]
        for bit in rng.integers(0, 64, int(rng.integers(1, 6))):
            x ^= 1 << int(bit)
        fps.append(x)
    dense = [fps[0] ^ m for m in range(256)]
    fps = sorted(set(fps + dense))
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in fps], "fp long")
    signed = [int(np.uint64(v).view(np.int64)) for v in fps]
    groups = {}
    for v, g in zip(signed, plain_components(fps)):
        groups.setdefault(g, []).append(v)
    truth = {v: min(g) for g in groups.values() if len(g) > 1 for v in g}
    links = S.links(frame)
    assert {r.node: r.root for r in connected_components(links).collect()} == truth
    assert links.count() <= 16 * len(fps)  # forests, not all pairs
    # the same in steps of any size
    rows = frame.select("fp", S.gray_rank(F.col("fp")).alias("rank"), F.explode(S.bucket_keys(F.col("fp"))).alias("key"))
    rows = rows.orderBy("key", "rank").toPandas()
    for frontier in (64, 4096):
        monkeypatch.setattr(S, "FRONTIER", frontier)
        distinct, nodes = np.unique(rows.fp.to_numpy(), return_inverse=True)
        labels = S.bucket_links(rows.key.to_numpy(), rows.fp.to_numpy().view(np.uint64), nodes, np.arange(len(distinct)))
        assert {int(distinct[i]): int(distinct[g]) for i, g in enumerate(labels) if (labels == g).sum() > 1} == truth


def test_operator_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows.sort()
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(fps)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs).collect()}
    for (i, _), f, c in zip(rows, fps, comp):
        assert got[i] == (f, rows[c][0])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    got = pd.DataFrame([(r.doc_id, r.fp, r.component_id) for r in S.near_duplicates(odd_docs).collect()], columns=["i", "fp", "c"])
    assert len(got) == odd_docs.count()
    assert (got[got.i.isin([1, 2, 3])].fp == 0).all() and (got[got.i.isin([1, 2, 3])].c == 1).all()
    assert (got[got.i.isin([4, 5])].c == 4).all() and (got[got.i.isin([6, 7])].c == 6).all()
    kept = S.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 4, 6, 8, 9, 10, 11} - ({None} if got[got.i.isna()].c.notna().any() else set())
    assert S.near_duplicates(no_docs).count() == 0


def test_near_copies_of_long_texts_meet(spark):
    r = random.Random(0)
    text = [f"w{r.randrange(500)}" for _ in range(4000)]
    near = [*text]
    near[1000] = "changed"
    rows = S.near_duplicates(make_docs(spark, [" ".join(text), " ".join(near), " ".join(r.sample(text, 4000))])).collect()
    assert {x.doc_id: x.component_id for x in rows} == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch, block):
    """A family with one band in common fills buckets beyond HOT; links and components are those of all pairs."""
    r = random.Random(block)
    base = r.getrandbits(64)
    fps = {base ^ (r.getrandbits(14) << 20) ^ (1 << r.randrange(40, 64)) for _ in range(400)} | {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(S, "HOT", 60)
    monkeypatch.setattr(S, "BLOCK", block)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    rows = frame.select("fp", S.gray_rank(F.col("fp")).alias("rank"), F.explode(S.bucket_keys(F.col("fp"))).alias("key"))
    assert rows.groupBy("key").count().where("count > 60").count()
    truth = {}
    for i, c in enumerate(plain_components(fps)):
        truth.setdefault(c, []).append(signed[i])
    want = {f: min(g) for g in truth.values() if len(g) > 1 for f in g}
    found = S.links(frame)
    assert {x.node: x.root for x in connected_components(found).collect()} == want
