import base64
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from churnlens.llm import secret_scan as S
from corpus_docs import make_docs

EITHER = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile("(%s)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
    [*map(EITHER, ("password", "passwd", "secret", "token")), EITHER("api") + "_?" + EITHER("key")]))


def brute(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def test_base_matches_plain_patterns():
    r = random.Random(0)
    parts = ["token", "ſecret", "Password", " ", ":", "=", '"', "AKIA", "a1b2", "ABCD", "0123456789abcdef", "é", ".", "+", "K", "api_key", "toKen", "-_"]
    for _ in range(20000):
        t = "".join(r.choices(parts, k=r.randrange(12)))
        assert S.base_spans(t) == brute(t), t


def test_random_strings_are_found_and_words_are_not(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["the", "ing", "er", "on", "an", "re", "st", "is"]) for _ in range(r.randrange(1, 4)))
    texts, planted = [], {}
    for i in range(1500):
        words = [word() for _ in range(80)] + ["internationalisation", "counterrevolutionaries"]
        if i % 10 == 0:
            words.insert(7, base64.b64encode(r.randbytes(24)).decode())
            planted[i] = words[7]
        texts.append(" ".join(words))
    rows = S.find_secrets(make_docs(spark, texts)).collect()
    found = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == 3] for r in rows}
    hit = sum(any(p.strip("=") in f or f in p for f in found[i]) for i, p in planted.items())
    false = sum(len(f) for i, f in found.items() if i not in planted)
    assert hit >= 0.8 * len(planted) and false <= 0.1 * len(planted)


def test_randomness_is_uniform_for_random_strings():
    r = random.Random(3)
    chars = S.ALPHABETS[8]
    scores = [S.randomness("".join(r.choices(chars, k=40)), 8) for _ in range(1500)]
    assert 0.4 < sum(scores) / len(scores) < 0.65 and 0.02 < sum(s < 0.1 for s in scores) / len(scores) < 0.2


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    got = S.find_secrets(odd_docs).select("doc_id", S.span_list(F.col("base")).alias("b"), S.count_kind(F.col("base"), "assign").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.b, r.n) for r in got if r.b) == [(11, "assign:0:24", 1)]
    assert len(got) == odd_docs.count() and S.find_secrets(no_docs).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_digest(spark, sf):
    from churnlens.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_secret_scan"](spark, f"/root/testdata/{sf}").collect():
        own = brute(texts[r.doc_id])
        listed = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in own)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in own) for x in range(3))


def test_every_part_of_a_run_is_tested():
    r = random.Random(2)
    key = "".join(r.choices(S.ALPHABETS[7], k=64))
    for text, start in ((f"x AUTH_KEY={key} y", 11), (f"a=b={key}== y", 4), (f"sig={key}&k", 4), (f"up_to+{key} y", 6)):
        assert any(s <= start and start + 64 <= e for s, e, _ in S.candidates(text, S.base_spans(text))), text
    text = "AKIA" + "Z" * 16 + "_" + key
    assert [(s, e) for s, e, _ in S.candidates(text, S.base_spans(text))] == [(20, 85)]
    text = key[:20] + "+" + key[20:40] + "_" + key[40:]
    assert [text[s:e] for s, e, _ in S.candidates(text, [])] == [key[:20] + "+" + key[20:40], key[40:]]


def test_pieces_lie_in_runs_outside_base_spans():
    r = random.Random(4)
    parts = ["AKIA", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "Zz9", "=", "+", "/", "-", "_", " ", "token=", "é"]
    for _ in range(5000):
        t = "".join(r.choices(parts, k=r.randrange(14)))
        base, end = S.base_spans(t), 0
        for at, part, alphabet in S.pieces(t, base):
            assert at >= end and t[at:at + len(part)] == part and len(part) >= 16 and set(part) <= set(S.ALPHABETS[alphabet])
            assert not any(s < at + len(part) and at < e for s, _, e in base)
            end = at + len(part)


@pytest.mark.parametrize("n", [1, 2, 40, 100, 1000])
def test_a_planted_string_is_found_in_a_table_of_any_size(spark, n):
    r = random.Random(n)
    words = ["the", "house", "on", "hill", "was", "empty", "for", "years", "until", "somebody", "came", "along"]
    texts = [" ".join(r.choices(words, k=80)) + " " + "".join(r.choices(S.ALPHABETS[7], k=64)) + " " + " ".join(r.choices(words, k=20)) for _ in range(n)]
    texts += [" ".join(r.choices(words, k=100)) + " internationalisationandthelike counterrevolutionarieswere" for _ in range(n)]
    rows = {x.doc_id: [texts[x.doc_id][s.start:s.end] for s in x.spans if s.kind == 3] for x in S.find_secrets(make_docs(spark, texts)).collect()}
    assert sum(any(len(f) == 64 for f in rows[i]) for i in range(n)) >= 0.97 * n
    assert sum(bool(rows[n + i]) for i in range(n)) <= 0.05 * n


def test_evidence_of_many_is_that_of_one():
    r = random.Random(8)
    for a, size in ((0, 16), (3, 24), (7, 64), (9, 48)):
        chars = S.ALPHABETS[a]
        strings = ["".join(r.choices(chars, k=size)) for _ in range(60)] + [chars[0] * size, (chars[:2] * size)[:size], "".join(r.choices(chars[:5], k=size))]
        x = S._TABLES[a][[list(s.encode()) for s in strings]]
        for s, v in zip(strings, S.evidence(x, len(chars))):
            p = S.randomness(s, a)
            assert p < 1e-290 or abs(-math.log10(p) - v) < 1e-6 * max(1, v), s


def plain_battery(s, a):
    """The three tests written out, without arrays."""
    chars = S.ALPHABETS[a]
    x, n, k = [chars.index(c) for c in s], len(s), len(chars)
    chi = sum((x.count(i) - n / k) ** 2 / (n / k) for i in range(k))
    upper = lambda z: math.erfc(z / math.sqrt(2)) / 2
    p1 = upper(((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1)))) if chi > 1e-9 else 1.0
    side = [i >= k / 2 for i in x]
    up, down = side.count(True), side.count(False)
    if up and down:
        mu = 1 + 2 * up * down / n
        runs = 1 + sum(p != q for p, q in zip(side, side[1:]))
        p2 = 2 * upper(abs(runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9)))
    else:
        p2 = 2 * 0.5 ** n
    mean = sum(x) / n
    var = sum((i - mean) ** 2 for i in x)
    p3 = 2 * upper(abs(sum((i - mean) * (j - mean) for i, j in zip(x, x[1:])) / var) * math.sqrt(n)) if var else 0.0
    h = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-h) * (1 + h + h * h / 2)


def test_battery_against_plain_formulas():
    r = random.Random(12)
    for a in range(len(S.ALPHABETS)):
        for size in (16, 33, 64):
            s = "".join(r.choices(S.ALPHABETS[a], k=size))
            assert math.isclose(S.randomness(s, a), plain_battery(s, a), rel_tol=1e-9, abs_tol=1e-300)


def test_benjamini_hochberg_against_its_definition():
    r = random.Random(6)
    for _ in range(30):
        decoy = {S._code(a, c, k): r.randrange(1, 200) for a in (2, 7) for c in range(5) for k in r.sample(range(S.STEPS), 20)}
        seen = {S._code(a, c, k): r.randrange(1, 5) for a in (2, 7) for c in range(5) for k in [*range(3), *r.sample(range(S.STEPS), 6)]}
        p, want = S.p_values(decoy), set()
        for a in (2, 7):
            tests = sorted(p[divmod(code, S.STEPS)] for code, n in seen.items() for _ in range(n) if code // S.STEPS // 5 == a)
            line = max([x for i, x in enumerate(tests, 1) if x <= S.RATE * i / len(tests)], default=-1)
            want |= {code for code in seen if code // S.STEPS // 5 == a and p[divmod(code, S.STEPS)] <= line}
        assert S.accepted_codes(seen, decoy) == want


def test_decoys_cover_the_whole_text_whatever_the_others():
    r = random.Random(4)
    texts = [(k, "".join(r.choices("abc déF.", k=r.choice([5, 300, 9000]))).encode()) for k in range(20)]
    alone = sorted(c for t in texts for c in S.decoys([t]).tolist())
    assert alone == sorted(S.decoys(texts).tolist())
    letters = sum(len(t.translate(None, S._NOT_LETTERS)) for _, t in texts)
    used = sum(S.LENGTHS[c // S.STEPS % 5] for c in alone)
    assert letters - 20 * 2 * 64 <= used <= letters
