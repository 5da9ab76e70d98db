"""License scan with a positional rare-token index.

Templates are short license passages with mandatory key phrases at fixed places.
1. One pass counts in how many documents each licence word stands (its IDF).
2. Each template is indexed under its two highest-IDF mandatory words and their
   places.  A document word that is such a posting proposes the only placement
   that fits; the second posting must stand at its relative place (intersection
   by position); then every mandatory phrase is compared word for word.
3. A placement's score is the share of template words that stand where the
   template has them; a label needs ``min_score``.

Both index words are mandatory, so no placement is lost by looking up rare words
only.  The index is as large as the fixed template list, whatever the corpus.

Null texts are empty and have no words: zero counts, null places, empty labels,
score 0.  Repeated rows get the same result each.  An empty table gives an empty
result; input columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_struct_rows, keyed, left_join_on_key, word_count, words_of


@dataclass(frozen=True)
class Template:
    """A passage of one word or more and the phrases in it that must stand; the first phrase begins the passage."""

    label: str
    passage: str
    phrases: tuple[str, ...]
    base: bool = False

    def placed(self) -> list[tuple[int, list[str]]]:
        """(place of its first word in the passage, words) of each phrase."""
        words = self.passage.split()
        found = [(next(i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()), p.split())
                 for p in self.phrases]
        assert found[0][0] == 0
        return found


def _whole(label: str, phrase: str, base: bool = False) -> Template:
    return Template(label, phrase, (phrase,), base)


# fixed values: base phrases first, then passages of public licences
TEMPLATES = (
    _whole("mit", "under the mit license", base=True),
    _whole("apache-2", "apache license version 2", base=True),
    _whole("cc-by-nc", "cc by nc", base=True),
    _whole("gpl-3", "gnu general public license version 3"),
    _whole("gpl-2", "gnu general public license version 2"),
    _whole("lgpl", "gnu lesser general public license"),
    _whole("agpl", "gnu affero general public license"),
    _whole("cc-by-sa", "cc by sa"),
    _whole("cc-by-nd", "cc by nd"),
    _whole("cc0", "cc0 1 0 universal"),
    _whole("mpl-2", "mozilla public license v 2 0"),
    _whole("unlicense", "free and unencumbered software released into the public domain"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                         "compliance with the license",
             ("licensed under the apache license", "may not use this file except in compliance")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "permitted provided that")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
                    "is hereby granted",
             ("permission to use copy modify and or distribute", "for any purpose with or without fee")),
)


def _vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for _, words in t.placed() for w in words})


def licence_word_counts(rows: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each mandatory word stands; as many entries as the templates have words."""
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary(templates)])
    held = rows.select(F.explode(F.array_intersect(words_of(F.col("text")), vocabulary)).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _postings(templates: tuple[Template, ...], counts: dict[str, int]) -> list[Column]:
    """One struct per template: its rarest mandatory word with place, the second one, the passage and the phrases."""
    out, most = [], max(len(t.phrases) for t in templates)
    for number, t in enumerate(templates):
        placed = sorted((counts.get(w, 0), w, at + i) for at, words in t.placed() for i, w in enumerate(words))
        (held, word, at), (_, word2, at2) = (placed * 2)[:2]  # a template of one word has that one posting
        if held == 0:  # no document has the word, so none has the template
            continue
        phrases = t.placed()  # shorter lists repeat their last phrase
        out.append(F.struct(
            F.lit(number).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
            F.lit(word).alias("word"), F.lit(at).alias("at"), F.lit(word2).alias("word2"), F.lit(at2).alias("at2"),
            F.array(*map(F.lit, t.passage.split())).alias("passage"),
            *[c for j in range(most) for a, words in [phrases[min(j, len(phrases) - 1)]] for c in (
                F.lit(a).alias(f"at_{j}"), F.lit(len(words)).alias(f"n_{j}"), F.lit(" ".join(words)).alias(f"phrase_{j}"))]))
    return out


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES, min_score: float = 0.6) -> DataFrame:
    """(doc_id, text_key, template, label, base, start, score): every verified placement."""
    rows = keyed(docs, id_col, text_col)
    postings = _postings(templates, licence_word_counts(rows, templates))
    if not postings:
        return rows.select("doc_id", "text_key", F.lit(0).alias("template"), F.lit("").alias("label"),
                           F.lit(False).alias("base"), F.lit(0).alias("start"), F.lit(0.0).alias("score")).limit(0)
    index = as_struct_rows(docs.sparkSession, postings)
    words = rows.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    placed = (words.select("doc_id", "text_key", "words", F.explode(places).alias("i"))
              .withColumn("w", F.get("words", F.col("i")))
              .join(F.broadcast(index), F.col("w") == F.col("word")))  # one row per template of the fixed list
    placed = placed.withColumn("start", F.col("i") - F.col("at")).where("start >= 0")
    placed = placed.where(F.get("words", F.col("start") + F.col("at2")) == F.col("word2"))
    at = F.greatest(F.col("start"), F.lit(0)) + 1
    # no lambda up to here: it would end code generation and copy all words with every place
    for j in range(max(len(t.phrases) for t in templates)):
        stands = F.concat_ws(" ", F.slice("words", at + F.col(f"at_{j}"), F.col(f"n_{j}")))
        placed = placed.where(stands == F.col(f"phrase_{j}"))
    # a generator, so that the score below is not pulled into the join
    placed = placed.select("doc_id", "text_key", "template", "label", "base", "start", "passage",
                           F.explode(F.array(F.slice("words", at, F.size("passage")))).alias("here"))
    same = F.size(F.filter(F.arrays_zip(F.col("here").alias("a"), F.col("passage").alias("b")), lambda z: z["a"] == z["b"]))
    return (placed.withColumn("score", same / F.size("passage")).where(F.col("score") >= min_score)
            .select("doc_id", "text_key", "template", "label", "base", "start", "score").distinct())


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES, min_score: float = 0.6) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = find_licences(docs, id_col, text_col, templates, min_score)
    base_start = F.when(F.col("base"), F.col("start"))
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.count(base_start).alias("n_base"), F.min(base_start).alias("first"), F.max(base_start).alias("last"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("own"), F.collect_set("label").alias("every"),
        F.max("score").alias("best"))
    rows = keyed(docs, id_col, text_col).select("doc_id", "text_key", word_count(F.col("text")).alias("n_words"))
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return left_join_on_key(rows, per_doc).select(
        "doc_id", "text_key", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"),
        listed("own").alias("base_labels"), listed("every").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))
