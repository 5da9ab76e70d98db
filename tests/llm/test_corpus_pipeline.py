import corpus_pipeline as P
from churnlens.llm.source_mix import label_domains
from test_decontaminate import brute as contaminated
from test_simhash_dedup import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    expected = {i: t for i, t in rows.items() if t and any(map(str.isalpha, t))}
    last = {}
    for i in sorted(expected):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in expected[i])] = i
    exact = {i: expected[i] for i in last.values()}
    ids = sorted(exact)
    roots = plain_components([plain_fingerprint(exact[i]) for i in ids])
    near = {ids[r]: exact[ids[r]] for r in roots}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, _, _, bad in contaminated(list(near.items()), items) if not bad}
    wanted = [set(expected), set(exact), set(near), clean]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = {r.doc_id for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns and got == wanted[k]
        else:
            assert docs.columns == [*columns, "mix_rate", "mix_copies"] and got <= clean
            domains = {r.doc_id: r.domain for r in label_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            gone = clean - got
            assert sum(domains.get(i) == "good" for i in gone) <= 0.1 * len(clean)
    assert {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()} == got


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for k, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, SF)
            assert docs.columns[:len(columns)] == columns
        ids = [r.doc_id for r in docs.collect()]
        assert sorted(i or 0 for i in ids) == ([0, 5, 7, 8, 8, 10, 11] if ids else [])  # id 8 has two texts
