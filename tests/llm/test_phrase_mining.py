"""Phrase mining against brute force, with samples that fail and fields that lie."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_docs import make_docs

import churnlens.llm.phrase_mining as P


def brute(rows, least, most=5):
    found, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                found[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return {lang: {g: n for g, n in c.items() if n >= least} for lang, c in found.items()}, total


def ranked(rows, least, top, most=5):
    counts, total = brute(rows, least, most)
    out = []
    for lang, f in counts.items():
        best = []
        for g, a in f.items():
            if len(g) < 2 or any(len(h) > len(g) and n >= a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, n in f.items()):
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(11)
    rows = []
    for i in range(400):
        words = []
        while len(words) < 40:
            words += rng.choice([["New", "York", "city"], ["in", "the", "end", "of", "it"], ["é", "vu"], ["a", "a", "a"], [f"w{rng.randrange(30)}"],
                                 [f"w{rng.randrange(300)},"], ["x y"], ["stop."], ["Ümlaut"]])
        rows.append((rng.choice(["en", "fr", None]), rng.choice([" ", "\t ", "  "]).join(words)))
    return rows + [("en", None), ("en", ""), ("de", " .,; "), ("en", "one passage of six words here. " * 3000)]


def docs_of(spark, rows):
    frame = None
    for lang in {x for x, _ in rows}:
        part = make_docs(spark, [t for x, t in rows if x == lang], start=1000 * (1 + len(lang or "")), lang=lang)
        frame = part if frame is None else frame.unionByName(part)
    return frame


@pytest.mark.parametrize("share", [1, 4, 10_000])
def test_counts_are_exact_whatever_the_sample(spark, share):
    rows = texts()
    counts, total = brute(rows, 25)
    got = P.mine_phrases(docs_of(spark, rows), min_count=25, share=share).collect()
    assert len(got) == len({(r["lang"], r["phrase"]) for r in got})
    assert {r["lang"]: r["n"] for r in got if r["words"] == 0} == {x: n for x, n in total.items() if n}
    found = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in got if r["words"]}
    assert found == {(lang, g): n for lang, c in counts.items() for g, n in c.items()}


def test_ranked_result(spark):
    rows = texts()
    got = P.collocations(docs_of(spark, rows), min_count=25, top=40, share=4)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == ranked(rows, 25, 40)


def test_a_full_field_and_small_chunks_change_nothing(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(P, "_CHUNK", 500)
    monkeypatch.setattr(P, "build_field", lambda phrases, before=None: np.full(4, 2 ** 64 - 1, dtype=np.uint64))
    got = P.collocations(docs_of(spark, rows), min_count=25, top=40, share=4)
    assert sorted(tuple(r) for r in got.collect()) == ranked(rows, 25, 40)


def test_border_failures_are_expanded(spark, monkeypatch):
    """A sample that proposes nothing: every frequent phrase is a failure, and the expansion finds all."""
    rows = texts()
    empty = np.zeros(1 << 10, dtype=np.uint64)
    monkeypatch.setattr(P, "propose", lambda sample, least, most_words: (empty, 16))
    passes, real = [], P.frequent
    monkeypatch.setattr(P, "frequent", lambda *a, **k: passes.append(k) or real(*a, **k))
    got = P.collocations(docs_of(spark, rows), min_count=25, top=40)
    assert len(passes) == 2 and "before" in passes[1]
    assert sorted(tuple(r) for r in got.collect()) == ranked(rows, 25, 40)


def test_a_phrase_that_the_field_holds_by_chance_hides_no_longer_one(spark, monkeypatch):
    """The field has "a b c" but not its part "a b": the first pass misses both, so the expansion must count "a b c d"."""
    rows = [("en", "a b c d e.")] * 30
    held = ["a", "b", "c", "d", "e", "b c", "c d", "d e", "b c d", "c d e", "b c d e", "a b c"]
    field = P.build_field(spark.createDataFrame([("en", x) for x in held], "lang string, phrase string"))
    monkeypatch.setattr(P, "propose", lambda sample, least, most_words: (field, 16))
    docs = docs_of(spark, rows)
    found = {r["phrase"]: r["n"] for r in P.mine_phrases(docs, min_count=25).collect() if r["words"]}
    assert found == {" ".join("abcde"[i:j]): 30 for i in range(5) for j in range(i + 1, 6)}
    assert sorted(tuple(r) for r in P.collocations(docs, min_count=25).collect()) == ranked(rows, 25, 2000)


def test_slices_cut_between_pieces_only():
    data = b"aaa bbb\nccc\n" * 5 + b"d" * 50
    parts = list(P._slices(data, 10))
    assert b"".join(parts) == data and all(p.startswith(b"\n") for p in parts[1:])


def test_score_beyond_64_bits(spark):
    """Products of large counts pass 64 bits; the quotient is exact."""
    from pyspark.sql import functions as F
    a, n, l, r = 3_000_000_000_000, 90_000_000_000_000, 4_000_000_000_001, 5_000_000_000_003
    rows = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 0, "", n)], "lang string, words int, phrase string, n long")
    real = P.mine_phrases
    try:
        P.mine_phrases = lambda *x: rows.withColumn("words", F.col("words"))
        got = P.collocations(None).first()
    finally:
        P.mine_phrases = real
    assert got["score"] == 1000 * a * n // (l * r)


def test_odd_and_empty(spark, odd_docs, no_docs):
    assert P.collocations(no_docs).count() == 0
    got = P.collocations(odd_docs, min_count=2, top=5)
    assert got.where("score IS NULL OR rank > 5").count() == 0 and got.count()
