import random
import re

import pytest

from churnlens.llm import decontaminate as D
from corpus_docs import make_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for a in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[a:a + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for v, own in wins.items():
            for a in range(len(w) - len(v) + 1):
                if tuple(w[a:a + len(v)]) == v:
                    hit |= set(range(a, a + len(v)))
                    found |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast_rows", [D.BROADCAST_ROWS, 0])
def test_matches_brute_force_on_both_join_paths(spark, monkeypatch, broadcast_rows):
    r = random.Random(2)
    vocabulary = ["a", "b", "Ab", "é1", "x2", "The", "of", "zz"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 5, 9, 10, 11, 30, 40, 30])] + [(3, "of of of zz"), (None, "x2 x2 x2 x2"), (20, None)]
    docs = [text(n) for n in [0, 1, 2, 5, 20, 100, 300]] + [text(15) + " " + t + " " + text(4) for _, t in items if t] + [None]
    find = D.find_windows
    monkeypatch.setattr(D, "find_windows", lambda *a, **k: find(*a, **{**k, "broadcast_rows": broadcast_rows}))
    got = D.decontaminate(make_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == brute(list(enumerate(docs)), items)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "under the MIT license"), (2, "")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(D.decontaminate(odd_docs, items)) == brute(rows, [(1, "under the MIT license")])
    assert D.decontaminate(no_docs, items).count() == 0
    none = items.limit(0)
    assert all(not r.contaminated for r in D.decontaminate(odd_docs, none).collect())
    kept = D.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    assert D.drop_contaminated(odd_docs, none).count() == odd_docs.count()
