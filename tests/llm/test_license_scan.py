from churnlens.llm import license_scan as L
from corpus_docs import make_docs

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction")


def scan(docs):
    return {r.doc_id: r for r in L.scan_licences(docs).collect()}


def test_phrases_places_and_labels(spark):
    got = scan(make_docs(spark, [
        "x Under the MIT-License. under the mit license", "Apache License, Version 2.0; CC BY-NC 4.0", "under the MIT x license",
        "intro words " + MIT, MIT.replace("associated documentation files", "other strange words"),
        MIT.replace("to deal in", "to sell in"), "This is the GNU General Public License, version 3.", ""]))
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (2, 1, 5, "mit", 1.0)
    assert (got[1].n_base, got[1].base_labels) == (2, "apache-2,cc-by-nc")
    assert (got[2].n_base, got[2].first_word, got[2].labels) == (0, None, "")
    assert (got[3].n_base, got[3].labels, got[3].score) == (0, "mit", 1.0)
    assert got[4].labels == "mit" and 0.6 <= got[4].score < 1.0
    assert got[5].labels == ""  # a mandatory phrase is missing
    assert got[6].labels == "gpl-3" and got[6].base_labels == ""
    assert (got[7].n_words, got[7].n_base, got[7].labels, got[7].score) == (0, 0, "", 0.0)


def test_every_template_finds_itself(spark):
    got = scan(make_docs(spark, [t.passage for t in L.TEMPLATES]))
    for i, t in enumerate(L.TEMPLATES):
        assert t.label in got[i].labels.split(",") and got[i].score == 1.0


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = L.scan_licences(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r.doc_id or 0, r.n_base) for r in rows if r.n_base) == [(0, 1), (4, 1), (4, 1), (5, 1)]
    assert L.scan_licences(no_docs).count() == 0
    assert L.scan_licences(make_docs(spark, ["nothing of the kind"])).first().n_base == 0


def test_templates_of_one_word_and_of_many(spark):
    templates = (L._whole("x", "zlib"), L._whole("y", "isc"), L.Template("z", "zlib license of nobody in particular at all", ("zlib license", "at all")))
    docs = make_docs(spark, ["the zlib and ZLIB words", "nothing", "isc", "a Zlib License of nobody in particular, at all", "zlib license of somebody in general at all"])
    got = {r.doc_id: r for r in L.scan_licences(docs, templates=templates).collect()}
    assert [got[i].labels for i in range(5)] == ["x", "", "y", "x,z", "x,z"]
    assert sorted((r.doc_id, r.start) for r in L.find_licences(docs, templates=templates).where("label = 'x'").collect()) == [(0, 1), (0, 3), (3, 1), (4, 0)]
