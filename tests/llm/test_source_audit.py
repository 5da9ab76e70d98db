"""The source audit against brute force in whole numbers."""

import random
import re
from collections import Counter, defaultdict

from churnlens.llm.source_audit import _cell_sums, audit_sources, count_terms  # noqa: F401


def brute(rows, min_docs, smooth=5, scale=10 ** 9, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")))
            for lang, source, text in rows]
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        count[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        n_lang = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + smooth) // (total + smooth * len(kept)) for t in kept}
        q, p = shares(n_lang), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "x", "y") for i, r in enumerate(rows)],
                                 "doc_id long, lang string, source string, text string, term long, p string, blocks string")


def same(spark, rows, **kw):
    got = audit_sources(table(spark, rows), **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, kw["min_docs"], **({"top": kw["top_terms"]} if "top_terms" in kw else {}))


def test_many_small_cells(spark):
    rng = random.Random(3)
    vocab = [a + b for a in "abcdeé" for b in "xyzß"]
    rows = [(rng.choice(["en", "de", None]), rng.choice([*(f"s{i}" for i in range(9)), None]),
             " ".join(rng.choices(vocab, weights=range(1, len(vocab) + 1), k=rng.randrange(0, 30))).upper()) for _ in range(300)]
    same(spark, rows, min_docs=4, group_block=2, term_block=3, top_terms=3)
    same(spark, rows, min_docs=4)


def test_odd_rows(spark):
    rows = [("en", "a", None), ("en", "b", ""), ("en", "c", "x 1 y-x\ty"), ("en", "c", "x 1 y-x\ty"), ("en", "d", "x " * 20_000),
            ("xx", "only", "nothing kept"), (None, None, "É é É"), ("", "", "É é"), ("yy", "p", "one"), ("yy", "q", "two")]
    same(spark, rows, min_docs=2)
    same(spark, rows, min_docs=2, group_block=1, term_block=1)


def test_empty(spark):
    assert audit_sources(table(spark, [])).count() == 0


def test_totals_beyond_64_bits(spark):
    """Counts of a large corpus times the scale pass 64 bits; the share must not."""
    from pyspark.sql import functions as F

    from churnlens.llm.source_audit import _share
    n, total, terms = 12_345_678_901_234, 98_765_432_109_876, 1_000_003
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("t"), F.lit(terms).alias("v")).select(_share("n", "t", "v", 5, 10 ** 9)).first()[0]
    assert got == 1 + 10 ** 9 * (n + 5) // (total + 5 * terms)
