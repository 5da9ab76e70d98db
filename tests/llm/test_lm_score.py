import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from churnlens.llm import lm_score as L
from corpus_docs import make_docs

SF = "/root/testdata/sf0.001"


def brute(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n,
                    round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens), key=repr)


def result(df):
    rows = df.collect()
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


@pytest.mark.parametrize("head", [L.HEAD, 20, 0])
def test_base_matches_brute_force_with_any_head(spark, head):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(L.score_texts(docs, head=head)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_small_steps_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted((r.doc_id, round(r.score, 6)) for r in L.score_texts(docs).collect())
    for name, value in (("VOCABULARY", 50), ("SCORE_CHUNK", 100), ("COUNT_CHUNK", 100)):
        monkeypatch.setattr(L, name, value)
    steps = L.score_texts(docs)
    assert result(steps) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, round(r.score, 6)) for r in steps.collect()) == whole


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert result(L.score_texts(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert L.score_texts(no_docs).count() == 0


def test_model_prefers_seen_order(spark):
    docs = make_docs(spark, ["the cat sat on the mat and the dog lay by the door"] * 40 + ["door the by lay dog the and mat the on sat cat the"], 0)
    rows = {r.doc_id: r for r in L.score_texts(docs).collect()}
    seen, shuffled = rows[2], rows[40]
    assert abs(seen.base_score - shuffled.base_score) < 1e-6 and seen.score > shuffled.score + 5


def test_filter_gives_quantised_counts(spark, monkeypatch):
    monkeypatch.setattr(L, "BITS_PER_LEVEL", 4000)
    rows = [" ".join([f"w{i}"] * n) for i, n in enumerate([1, 2, 3, 8, 100, 1000])]
    built = L.LogFrequencyFilter.of(64, [tuple(r) for r in L.build_blocks(spark.createDataFrame([(t,) for t in rows], "text string"), 64).collect()])
    got = L.quantised(built.levels(L.unigram_keys(L._hashes([f"w{i}".encode() for i in range(6)]))))
    assert [math.floor(math.log2(x)) for x in got] == [0, 1, 1, 3, 6, 9]


def exact_scores(rows):
    """The model's scores from exact counts, quantised, without any filter."""
    level = lambda n: 1.5 * 2.0 ** math.floor(math.log2(n)) - 0.5 if n else 0.0
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    learned = [ws for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for ws in learned for w in ws)
    two = Counter(p for ws in learned for p in zip([None, *ws], ws))
    whole = sum(one.values()) + 0.5 * (len(one) + 1)
    out = []
    for i, ws in tokens:
        score, before = 0.0, None
        for w in ws:
            alone, pair = (max(level(one[w]), 1.0 if one[w] else 0.0) + 0.5) / whole, max(level(two[before, w]), 1.0 if two[before, w] else 0.0)
            c = max(max(level(one[before]), 1.0 if one[before] else 0.0), pair) if before is not None else 0.0
            score += math.log10(min(1.0, L.BIGRAM_SHARE * pair / c + (1 - L.BIGRAM_SHARE) * alone if c > 0 else alone))
            before = w
        out.append((i, round(score, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [L.FILTER_BYTES, 0])
def test_score_from_exact_quantised_counts(spark, monkeypatch, most):
    """With so many bits that no level is false, both ways give the scores of exact quantised counts."""
    monkeypatch.setattr(L, "BITS_PER_LEVEL", 4000)
    monkeypatch.setattr(L, "PROBES", 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = L.score_texts(docs, filter_bytes=most * 64).collect()
    assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=repr) == exact_scores(rows)


def test_both_ways_probe_the_same_bits(spark, monkeypatch, odd_docs):
    monkeypatch.setattr(L, "SCORE_CHUNK", 20_000)
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        sent, asked = ([(r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in L.score_texts(docs, filter_bytes=most).collect()]
                       for most in (L.FILTER_BYTES, -1))
        assert sorted(sent, key=repr) == sorted(asked, key=repr) and len(sent) == docs.count()


def test_rate_of_false_levels_and_growth_of_the_filter():
    r = np.random.default_rng(1)
    low = np.unique(r.integers(0, 1 << 32, 200_000, dtype=np.uint64))
    n = r.integers(1, 50, len(low))
    absent = np.setdiff1d(r.integers(0, 1 << 32, 100_000, dtype=np.uint64), low)
    block = L.filled_block(low, n)
    events = L._levels_of(n).sum()
    assert abs(8 * len(block) - L.BITS_PER_LEVEL * events) < 64
    one = L.LogFrequencyFilter.of(1, [(0, block)])
    probe = lambda x: one.probe(np.zeros(len(x), dtype=np.int64), x)
    found = probe(low)
    assert (found >= L._levels_of(n)).all()
    assert (found > L._levels_of(n)).mean() < 0.04 and (probe(absent) > 0).mean() < 0.04  # (1 - e^(-3/8))^3 = 0.031


def test_blocks_grow_with_the_tokens():
    assert L.block_number(0) == L.LEAST_BLOCKS and L.block_number(10 ** 9) == 4096 and L.block_number(10 ** 30) == L.MOST_BLOCKS
    for blocks in (64, 4096, L.MOST_BLOCKS):
        keys = np.sort(np.random.default_rng(2).integers(0, 1 << L.KEY_BITS, 5000, dtype=np.uint64))
        block, places, low = L._by_block(keys, blocks)
        back = [(int(b) << L.LOW_BITS) | int(x) for b, data in zip(block, low) for x in L._unpacked(data)]
        spare = L.KEY_BITS - L.LOW_BITS - (blocks.bit_length() - 1)
        assert back == (keys >> np.uint64(spare)).tolist() and places[-1][1] == len(keys) and max(block) < blocks


def test_head_is_bounded_in_rows_and_bytes(spark):
    counts = spark.createDataFrame([(b"x" * 1000, 64), (b"a", 32), (b"b", 16), (b"c", 8)], "token binary, n long")
    assert L.head_cut(counts, 2) == 32 and L.head_cut(counts, 9) == 8 and L.head_cut(counts, 9, 1001) == 32 and L.head_cut(counts, 9, 10) == 1 << 62


def test_no_ngram_is_lost_however_many_there_are(spark):
    """Every learned n-gram is found, at its level or (seldom) above."""
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(60)]
    built = L.LogFrequencyFilter.of(64, [tuple(r) for r in L.build_blocks(spark.createDataFrame([(t,) for t in texts], "text string"), 64).collect()])
    h = L._hashes([w for t in texts for w in t.encode().split()]).reshape(60, 200)
    keys = np.concatenate([L.unigram_keys(h.ravel()), L.bigram_keys(h[:, :-1].ravel(), h[:, 1:].ravel())])
    assert (built.levels(keys) >= 1).all()


def test_a_task_that_scores_in_place_holds_little(spark, monkeypatch):
    """Check, op4: what a worker holds follows the small chunk, not all new tokens of a long one; the scores stay the same."""
    words = [f"w{i}" for i in range(1 << 20)]
    texts = [" ".join(words[i:i + 1024]) for i in range(0, len(words), 1024)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1024)), pa.array(range(1024)), pa.array(texts)], names=["doc_id", "text_key", "text"])
    known = L._hashes(w.encode() for w in words[:1])
    facts = L._TokenFacts(known, np.zeros(1, dtype=np.uint32), np.ones(1), 10.0)
    tracemalloc.start()
    most = 0
    for _, h, numbers, sizes, _ in L._read(iter([batch]), facts, 0, L.HERE_CHUNK):
        L._Chunk(h, numbers, sizes)
        most = max(most, len(facts.vocabulary))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= L.FACTS + L.HERE_CHUNK + 1025 and peak < 80 << 20, (most, peak)

    docs = make_docs(spark, texts[:3] + texts[:2] + ["", "w1 w2"], 0)
    few = [(r.doc_id, r.n_known, r.base_score, r.score) for r in L.score_texts(docs).sort("doc_id").collect()]
    monkeypatch.setattr(L, "HERE_CHUNK", 100)
    monkeypatch.setattr(L, "FACTS", 100)
    assert [(r.doc_id, r.n_known, r.base_score, r.score) for r in L.score_texts(docs).sort("doc_id").collect()] == few


def test_a_chunk_meets_bundles_not_blocks(spark, monkeypatch):
    """with many blocks a chunk sends a row for each bundle, which is probed once for many chunks; the levels stay the same."""
    blocks, words = 4096, [f"w{i % 7000}x{i % 11}" for i in range(30_000)]
    built = L.build_blocks(spark.createDataFrame([(" ".join(words[:20_000]),)], "text string"), blocks).localCheckpoint()
    whole = L.LogFrequencyFilter.of(blocks, [tuple(r) for r in built.collect()])
    chunks = {}
    for at in range(0, 30_000, 5000):
        vocabulary = L.Vocabulary()
        numbers = np.array([vocabulary[w.encode()] for w in words[at:at + 5000]])
        chunks[at] = (L._hashes(vocabulary).tobytes(), L._planes(numbers), [len(numbers)])
    rows = spark.createDataFrame([(k, *map(lambda x: bytearray(x) if isinstance(x, bytes) else x, c)) for k, c in chunks.items()],
                                 "chunk long, hashes binary, numbers binary, sizes array<int>")
    monkeypatch.setattr(L, "ASKED", 40)
    found = L.filter_levels(rows, built, blocks).collect()
    assert len(found) <= len(chunks) * L.BUNDLES and L.bundle_width(blocks) == 8
    for k, c in chunks.items():
        levels = b"".join(zlib.decompress(r[2]) for r in sorted((r for r in found if r[0] == k), key=lambda r: r[1]))
        assert (np.frombuffer(levels, dtype=np.uint8) == whole.levels(L._Chunk.read(*c).keys)).all()


def test_bundles_of_any_width_give_the_same_scores(spark, monkeypatch, odd_docs):
    """one block a bundle or several, sent whole or asked."""
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        monkeypatch.setattr(L, "BLOCK_TOKENS", 64)
        got = []
        for bundles, most in ((1 << 30, L.FILTER_BYTES), (1 << 5, L.FILTER_BYTES), (1 << 5, -1)):
            monkeypatch.setattr(L, "BUNDLES", bundles)
            got.append(sorted(((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in L.score_texts(docs, filter_bytes=most).collect()), key=repr))
        assert got[0] == got[1] == got[2] and len(got[0]) == docs.count()
