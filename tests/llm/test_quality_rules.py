"""The quality rules: counts by brute force, the ratio recomputed, and what is kept."""

import hashlib
import math
import random
import re
from collections import Counter

from corpus_docs import make_docs

from churnlens.llm.quality_rules import apply_rules, gram_weights, repeated_words

SPACE = r"[^\x20\x09-\x0D]+"


def counts(text):
    words = re.findall(SPACE, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def grams(text, buckets):
    h = [int(hashlib.md5("".join(c.lower() if c.isascii() else c for c in w).encode()).hexdigest()[:8], 16) for w in re.findall(SPACE, text or "")]
    return [x % buckets for x in h] + [(31 * x + y + 1) % buckets for x, y in zip(h, h[1:])]


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n)).replace("w7 ", "w7.\n")


def corpus(spark):
    rng = random.Random(5)
    good, bad = [f"w{i}" for i in range(12)], [f"Junk{i}!!" for i in range(60)]
    texts = [prose(rng, rng.randrange(60, 120), good) for _ in range(60)] + [prose(rng, 80, bad) for _ in range(20)]
    texts += ["short text", "again and again " * 40, "a # b\x0bc é d | <x>\n\n  \nline\nline\n" * 3, None, "", "w1 " * 30_000]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(i, 0, 0) for i in range(60, 70)] + [(None, 1, 0), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return texts, labels


def test_against_brute_force(spark):
    texts, labels = corpus(spark)
    got = {r["doc_id"]: r for r in apply_rules(make_docs(spark, texts), labels, buckets=512).collect()}
    assert len(got) == len(texts)
    raw = Counter(b for t in texts for b in grams(t, 512))
    target = Counter(b for t in texts[:40] for b in grams(t, 512))
    ratio = (sum(raw.values()) + 512) / (sum(target.values()) + 512)
    weight = {b: math.floor(1000 * math.log((target[b] + 1) / (raw[b] + 1) * ratio)) for b in raw}
    llr = [sum(weight[b] for b in g) // len(g) if (g := grams(t, 512)) else None for t in texts]
    own = sorted(x for x, t in list(zip(llr, texts))[:40] if counts(t)[0] >= 50)
    least = own[math.floor(0.001 * len(own))] - 60
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = counts(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        failed = n < 50 or 100 * rep > 50 * n
        assert (r["llr"], r["least_llr"], r["base_failed"]) == (llr[i], least, failed)
        assert r["kept"] == (not failed and llr[i] >= least)
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 80))


def test_no_trusted_document_leaves_the_base_rules(spark):
    texts, labels = corpus(spark)
    got = apply_rules(make_docs(spark, texts), labels.where("quality = 2")).collect()
    assert all(r["kept"] != r["base_failed"] and r["least_llr"] in (None, -60) for r in got if r["n_words"])


def test_bounded_ids_and_partitions_do_not_matter(spark):
    texts, labels = corpus(spark)
    docs = make_docs(spark, texts)
    one, many = (sorted((r["doc_id"], r["llr"], r["kept"]) for r in apply_rules(d, labels).collect()) for d in (docs.coalesce(1), docs.repartition(13)))
    assert one == many
    few = apply_rules(docs, labels, trusted=5)
    assert few.count() == len(texts) and few.where("kept").count()


def test_every_trusted_document_is_counted(spark, monkeypatch):
    """More trusted documents than the 20 000 that a fit once took: each one's words weigh, with a broadcast and without."""
    import churnlens.llm.quality_rules as Q
    docs = spark.range(50_000).selectExpr("id AS doc_id", "concat(repeat('w ', 50), 'own', id) AS text")
    labels = spark.range(50_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    found = []
    monkeypatch.setattr(Q, "gram_weights", lambda raw, target: found.append((raw, target)) or gram_weights(raw, target))
    rows = [sorted(map(tuple, apply_rules(docs, labels).groupBy("llr", "least_llr", "kept").count().collect()))]
    monkeypatch.setattr(Q, "SENT", 10)
    rows.append(sorted(map(tuple, apply_rules(docs, labels).groupBy("llr", "least_llr", "kept").count().collect())))
    assert len(found) == 2 and all((raw == target).all() and raw.sum() == 50_000 * 101 for raw, target in found)
    assert rows[0] == rows[1] == [(0, -60, False, 50_000)]  # the base rules drop texts that repeat themselves


def test_odd_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    got = apply_rules(odd_docs, labels)
    assert got.count() == odd_docs.count()
    assert got.where("text_key IS NULL OR kept IS NULL OR base_failed IS NULL").count() == 0
    assert got.where("n_words = 0 AND (kept OR llr IS NOT NULL)").count() == 0
    assert apply_rules(no_docs, labels).count() == 0
    assert apply_rules(odd_docs, labels.where("false")).count() == odd_docs.count()


def test_repeated_words_of_a_wide_vocabulary():
    import numpy as np
    ids = np.array([2 ** 30, 5, 2 ** 30 - 1] * 2 + [9, 8])
    assert repeated_words(ids) == 6
    assert repeated_words(np.array([1, 1, 1])) == 0 and repeated_words(np.array([1, 1, 1, 1])) == 4
