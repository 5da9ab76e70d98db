import hashlib
import random

import pytest
from pyspark.sql import functions as F

from churnlens.llm import exact_dedup as D
from corpus_docs import make_docs


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_matches_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abEÉ .\nİß") for _ in range(r.choice([0, 1, 3, 900, 5000]))) for _ in range(60)]
    texts += [t.swapcase() if t.isascii() else t for t in texts[:30]] + [t[:-1] + "z" for t in texts if t]
    docs = make_docs(spark, texts)
    assert got(D.exact_dedup(docs)) == brute(list(enumerate(texts)))


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(D.exact_dedup(odd_docs)) == brute(rows)
    kept = D.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [2, 3, 5, 7, 8, 8, 9, 10, 11]  # 1 equals 2, 4 equals 5, 6 equals 7; both texts of id 8 stay
    assert kept.where("doc_id IS NULL").count() == 1


def test_empty_table(spark, no_docs):
    assert D.exact_dedup(no_docs).count() == 0 and D.drop_exact_duplicates(no_docs).columns == no_docs.columns


SCRIPTS = {
    "latin": lambda r: "".join(r.choice("abcdeinorst") for _ in range(r.randrange(1, 9))) + " ",
    "cjk": lambda r: chr(r.randrange(0x4E00, 0x9000)),
    "hiragana": lambda r: chr(r.randrange(0x3041, 0x3097)),
    "cyrillic": lambda r: "".join(chr(r.randrange(0x430, 0x450)) for _ in range(r.randrange(1, 9))) + " ",
    "code": lambda r: r.choice(["if (x", " == ", "0x", "{\n", "return", ";\n", "    ", "a[i]", "++", "} "]) + str(r.randrange(100)),
    "emoji": lambda r: chr(r.randrange(0x1F300, 0x1F600)),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_chunks_restore_the_text_and_realign(spark, script):
    r = random.Random(1)
    text = "".join(SCRIPTS[script](r) for _ in range(20_000))
    df = spark.createDataFrame([(text, text[0] + text, text[:9000] + "x" + text[9000:])], "a string, b string, c string")
    a, b, c = df.select(*[D.chunks_of(D.hex_of(F.col(x))) for x in "abc"]).first()
    for chunks, whole in ((a, text), (b, text[0] + text), (c, text[:9000] + "x" + text[9000:])):
        parts = [bytes.fromhex(x) for x in chunks]
        assert b"".join(parts) == whole.encode() and max(map(len, parts)) <= D.MAX_BYTES
        assert all(p.decode() for p in parts)  # no character is cut
    assert len(a) > 8 and len(set(a) & set(b)) > 0.7 * len(a) and len(set(a) & set(c)) > 0.7 * len(a)  # cuts follow content


def test_ambiguous_identifiers_are_found(spark, monkeypatch):
    docs = make_docs(spark, ["one", "two"]).select("text")
    assert D.ambiguous_ids(docs).count() == 0
    monkeypatch.setattr(D, "chunk_id", lambda c: F.substring(c, 0, 0).cast("binary"))
    assert D.ambiguous_ids(docs).count() == 1


def test_colliding_identifiers_are_told_apart(spark, monkeypatch, odd_docs):
    """One bit of identifier: nearly all collide, and the result is that of brute force."""
    monkeypatch.setattr(D, "chunk_id", lambda c: F.unhex(F.lpad((F.crc32(c) % 2).cast("string"), 2, "0")))
    r = random.Random(4)
    texts = ["".join(r.choice("abE .\né") for _ in range(r.choice([0, 1, 3, 900, 9000]))) for _ in range(40)]
    texts += texts[:20] + [t[:-1] + "z" for t in texts if t]
    assert got(D.exact_dedup(make_docs(spark, texts))) == brute(list(enumerate(texts)))
    assert got(D.exact_dedup(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
