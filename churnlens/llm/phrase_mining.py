"""Phrase collocations by Toivonen mining: a sample proposes, full passes count and close.

A phrase is frequent in its language from ``min_count`` occurrences on; its parts
are then frequent too.
1. Sample: ``SHARE`` of the documents, chosen by a hash of the row, is mined level
   by level at a lowered limit; the result is the proposal S.
2. Full pass: every text is counted exactly for S and its negative border, that is
   for each phrase whose two parts (without the last, without the first word) are
   in S, and each single word.
3. A frequent phrase outside S is a border failure: its extensions were not
   counted.  Failures join S, and an expansion pass counts what has become
   countable, short phrases first: a phrase that this pass counts may itself be a
   part of longer ones that it counts.  All that it counts has a failure inside,
   so its volume is bounded by the failures' own counts, and one pass closes the
   set whatever the length of the failures' extensions.

S travels as one bit field of at most ``MOST_SLOTS`` 64-bit slots, so what is
broadcast is bounded however many phrases are frequent.  A phrase that the field
holds by chance is only counted in vain: counts are exact, and failures are judged
against the same field, so the result does not hang on field or sample.  Counts
leave a task added up over about ``_CHUNK`` words, packed and compressed for each
(language, bucket of phrases), and are merged there; the number of buckets grows
with the words.  A phrase is sent once a chunk however often it occurs, and texts
never move.

Null texts are empty, null languages ``und``.  Repeated rows count each.  Ids are
not used; other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_n_per_group
from ..session import cut_lineage

MIN_COUNT, MOST_WORDS, TOP = 100, 5, 2000
SHARE, SLACK = 8, 2.4  # one document in SHARE; standard deviations below the expected count
MOST_SLOTS, BITS_A_PHRASE = 1 << 22, 16
_CHUNK = 1 << 20  # words that are counted at once
# fixed values: A-Z to a-z, tab to space, every character that ends a piece to a line feed
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def extend(prints: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit prints of phrases that are one word longer (wrapping arithmetic)."""
    x = prints * np.uint64(0x9E3779B97F4A7C15) + words
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _place(prints: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and bits (four) of each print; ``slots`` is a power of two."""
    one, bits = np.uint64(1), np.zeros(len(prints), dtype=np.uint64)
    for shift in (40, 46, 52, 58):
        bits |= one << ((prints >> np.uint64(shift)) & np.uint64(63))
    return (prints & np.uint64(slots - 1)).astype(np.int64), bits


def holds(field: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot, bits = _place(prints, len(field))
    return field[slot] & bits == bits


def phrase_prints(lang: list[str], phrase: list[str]) -> np.ndarray:
    """The print of each (language, phrase)."""
    out = np.zeros(len(lang), dtype=np.uint64)
    for i, (place, text) in enumerate(zip(lang, phrase, strict=True)):
        x = np.array([_hash(place.encode())], dtype=np.uint64)
        for word in text.split(" "):
            x = extend(x, np.array([_hash(word.encode())], dtype=np.uint64))
        out[i] = x[0]
    return out


def build_field(phrases: DataFrame, before: np.ndarray | None = None) -> np.ndarray:
    """A bit field of (lang, phrase) rows, and of all that ``before`` holds."""
    slots = len(before) if before is not None else 1 << 10
    if before is None:
        need = phrases.count() * BITS_A_PHRASE // 64
        while slots < min(need, MOST_SLOTS):
            slots *= 2

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, bits = _place(phrase_prints(batch.column(0).to_pylist(), batch.column(1).to_pylist()), slots)
            yield pa.record_batch({"slot": slot, "bits": bits.view(np.int64)})

    found = (phrases.select("lang", "phrase").mapInArrow(placed, "slot long, bits long")
             .groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow())
    field = np.zeros(slots, dtype=np.uint64) if before is None else before.copy()
    field[found["slot"].to_numpy()] |= found["bits"].to_numpy().view(np.uint64)
    return field


def _numbers(lang: str, words: list[bytes], langs: list[str]) -> dict:
    """Numbers the words of a language as it meets them; -1 ends a piece, -2 is no word."""
    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = number = len(words)
            words.append(word)
            langs.append(lang)
            return number
    return Numbers({b"": -2, b"\n": -1})


def _slices(data: bytes, most: int = 1 << 23) -> Iterator[bytes]:
    """A text in slices of about ``most`` bytes, cut where a piece ends."""
    start = 0
    while len(data) - start > most and (end := data.find(b"\n", start + most)) >= 0:
        yield data[start:end]
        start = end
    yield data[start:]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, list[bytes], list[str]]]:
    """Word numbers of about ``size`` words of whole pieces, the words, and their languages."""
    def fresh():
        return [], [], {}, []

    words, langs, known, parts = fresh()
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in known:
                known[lang] = _numbers(lang, words, langs)
            for data in _slices(text.as_py().translate(_PLAIN)):
                tokens = (data + b"\n").replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(known[lang].__getitem__, tokens), dtype=np.int64, count=len(tokens))
                parts.append(ids[ids != -2])
                held += len(parts[-1])
                if held >= size:
                    yield np.concatenate(parts), words, langs
                    words, langs, known, parts = fresh()
                    known[lang], held = _numbers(lang, words, langs), 0
    if parts:
        yield np.concatenate(parts), words, langs


def _added_up(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of occurrences of each distinct phrase of ``k`` words among the places ``at``."""
    code = ids[at]
    for j in range(1, k):
        if j > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = (code << 31) | ids[at + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return at[first], n


def _phrases(chunk: tuple[np.ndarray, list[bytes], list[str]], levels: range, field: np.ndarray | None,
             before: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, place of each distinct phrase of k words, its occurrences, its print), level by level."""
    ids, words, langs = chunk
    word_prints = np.array([_hash(w) for w in words], dtype=np.uint64)
    of_lang = {x: _hash(x.encode()) for x in set(langs)}
    begin = extend(np.array([of_lang[x] for x in langs], dtype=np.uint64), word_prints)
    at = np.flatnonzero(ids >= 0)
    if 1 in levels:
        place, n = _added_up(ids, at, 1)
        yield 1, place, n, begin[ids[place]]
    if levels[-1] == 1:
        return
    known = holds(field, begin)[ids[at]]  # single words are looked up once each
    old = holds(before, begin)[ids[at]] if before is not None else np.zeros(len(at), dtype=bool)
    at, prints, old = at[known], begin[ids[at[known]]], old[known]
    for k in range(2, levels[-1] + 1):
        # both parts must be known: neighbours among the places whose k - 1 words are
        pair = np.flatnonzero(at[1:] == at[:-1] + 1)
        pair = pair[ids[at[pair] + k - 1] >= 0] if k > 2 else pair
        fresh = ~(old[pair] & old[pair + 1])
        at, prints = at[pair], extend(prints[pair], word_prints[ids[at[pair] + k - 1]])
        if k in levels and fresh.any():
            place, n = _added_up(ids, at[fresh], k)
            yield k, place, n, prints[np.searchsorted(at, place)]
        if k == levels[-1] or not len(at):
            return
        # what the old field holds by chance, without one of its parts, was not counted and is not old
        old = holds(before, prints) & ~fresh if before is not None else np.zeros(len(at), dtype=bool)
        known = holds(field, prints)
        if before is not None:  # an expansion: what is counted now is extended now
            known |= fresh
        at, prints, old = at[known], prints[known], old[known]


def _count(batches: Iterator[pa.RecordBatch], levels: range, field: np.ndarray | None, before: np.ndarray | None, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's sums as (lang, bucket, phrases, size, counts): phrases end in a line feed, the total of words is the empty one."""
    for chunk in _chunks(batches, _CHUNK):
        ids, words, langs = chunk
        if not words:
            continue
        vocabulary = pa.array(words, pa.binary())
        places = pa.array(langs, pa.string()).dictionary_encode()
        lang_of = np.asarray(places.indices)
        texts, lang, prints, counts = [], [], [], []
        if 1 in levels:
            total = np.bincount(lang_of[ids[ids >= 0]], minlength=len(places.dictionary))
            texts.append(pa.array([b"\n"] * len(total), pa.binary()))
            lang.append(np.arange(len(total)))
            prints.append(np.zeros(len(total), dtype=np.uint64))
            counts.append(total)
        for k, place, n, own in _phrases(chunk, levels, field, before):
            parts = [vocabulary.take(pa.array(ids[place + j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
            texts.append(pc.binary_join_element_wise(phrase, pa.scalar(b""), b"\n"))
            lang.append(lang_of[ids[place]])
            prints.append(own)
            counts.append(n)
        if not texts:
            continue
        lang, n = np.concatenate(lang), np.concatenate(counts).astype("<i8")
        bucket = (np.concatenate(prints) >> np.uint64(7)) % np.uint64(buckets)
        group = lang.astype(np.int64) * buckets + bucket.astype(np.int64)
        order = np.argsort(group, kind="stable")  # phrases with the same first word stay together, which compresses
        group, n = group[order], n[order]
        text = pa.concat_arrays(texts).take(pa.array(order))
        ends, data = np.frombuffer(text.buffers()[1], dtype=np.int32)[:len(text) + 1], text.buffers()[2]
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            raw = data.slice(int(ends[a]), int(ends[b] - ends[a]))
            rows.append((places.dictionary[int(group[a] // buckets)].as_py(), int(group[a] % buckets), pa.compress(raw, "zstd", asbytes=True), len(raw),
                         pa.compress(n[a:b].tobytes(), "zstd", asbytes=True), b - a))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()))],
                              names=["lang", "bucket", "phrases", "size", "counts", "number"])


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The sums of a (lang, bucket) over all chunks, from ``least`` on; rows come in order."""
    def merged(lang: str, rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(pa.decompress(p, size, "zstd", asbytes=True) for p, size, _, _ in rows), dtype=np.uint8)
        n = np.concatenate([np.frombuffer(pa.decompress(c, 8 * k, "zstd", asbytes=True), dtype="<i8") for _, _, c, k in rows])
        ends = np.concatenate(([0], np.flatnonzero(data == 10) + 1)).astype(np.int64)
        phrase = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        sums = pa.table({"phrase": phrase, "n": n}).group_by("phrase").aggregate([("n", "sum")])
        total = pc.equal(sums["phrase"], pa.scalar(b"\n", pa.large_binary()))
        sums, total = (x.filter(pc.or_(pc.greater_equal(sums["n_sum"], least), total)) for x in (sums, total))
        text = pc.utf8_rtrim(sums["phrase"].cast(pa.large_string()).cast(pa.string()), "\n").combine_chunks()
        words = pc.add(pc.count_substring(text, " "), 1)
        words = pc.if_else(total.combine_chunks(), 0, words).cast(pa.int32())
        return pa.record_batch([pa.array([lang] * len(text), pa.string()), words, text, sums["n_sum"].combine_chunks()], names=["lang", "words", "phrase", "n"])

    at, held = None, []
    for batch in batches:
        for lang, bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, bucket) != at and held:
                yield merged(at[0], held)
                held = []
            at = (lang, bucket)
            held.append(row)
    if held:
        yield merged(at[0], held)


def bucket_number(words: int) -> int:
    """How many buckets (a power of two) the phrases of a language are dealt into, for so many words in all."""
    return min(max(1 << (int(words) // _CHUNK).bit_length(), 16), 1 << 18)


def frequent(texts: DataFrame, levels: range, field: np.ndarray | None, least: int, before: np.ndarray | None = None, buckets: int = 16) -> DataFrame:
    """(lang, words, phrase, n) from ``least`` occurrences on, of the phrases whose parts are in ``field``.

    With ``before``, an expansion: only phrases with a part outside it, and parts may also be phrases counted here.  Level 1
    counts every word and gives each language's total as the row of 0 words.
    """
    sent = texts.sparkSession.sparkContext.broadcast((field, before))  # at most 2 * ``MOST_SLOTS`` slots

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(batches, levels, *sent.value, buckets)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merge(batches, least)

    return (texts.mapInArrow(counted, "lang string, bucket int, phrases binary, size long, counts binary, number long")
            .repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
            .mapInArrow(merged, "lang string, words int, phrase string, n long"))


def outside(phrases: DataFrame, field: np.ndarray) -> DataFrame:
    """The (lang, phrase) rows that the field does not hold."""
    sent = phrases.sparkSession.sparkContext.broadcast(field)

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = ~holds(sent.value, phrase_prints(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield batch.filter(pa.array(gone))

    return phrases.select("lang", "phrase").mapInArrow(missing, "lang string, phrase string")


def propose(sample: DataFrame, least: int, most_words: int = MOST_WORDS) -> tuple[np.ndarray, int]:
    """The field of the sample's phrases of up to ``most_words`` - 1 words, mined level by level, and the sample's number of buckets."""
    found = cut_lineage(frequent(sample, range(1, 2), None, least))
    buckets = bucket_number(found.where("words = 0").agg(F.sum("n")).first()[0] or 0)
    found = found.where("words = 1")
    field = build_field(found)
    for k in range(2, most_words):
        found = found.unionByName(cut_lineage(frequent(sample, range(k, k + 1), field, least, buckets=buckets)))
        field = build_field(found)
    return field, buckets


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, share: int = SHARE,
                 id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, n): every phrase of up to ``most_words`` words with ``min_count`` occurrences in its language, and
    each language's number of words as the row of 0 words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.cast("binary").alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col), text), F.lit(share)).alias("part"))
    texts, expected = rows.select("lang", "text"), min_count / share
    least = max(2, int(expected - SLACK * expected ** 0.5))
    field, buckets = propose(cut_lineage(rows.where("part = 0").select("lang", "text")), least, most_words)
    found = cut_lineage(frequent(texts, range(1, most_words + 1), field, min_count, buckets=buckets * share))
    failed = cut_lineage(outside(found.where(F.col("words").between(1, most_words - 1)), field))
    if not failed.limit(1).count():
        return found
    # The expansion closes the set: a frequent phrase has frequent parts, and each of them is in the old field, a failure
    # (now in the wider field), or counted by the expansion itself, shorter ones first.
    closed = frequent(texts, range(2, most_words + 1), build_field(failed, field), min_count, before=field, buckets=buckets)
    return found.unionByName(cut_lineage(closed))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by their lowest-scoring cut."""
    mined = mine_phrases(docs, min_count, most_words, share)
    counts = mined.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = mined.where("words = 0").select("lang", "n")
    longer = mined.where("words > 2")
    # a phrase that a longer one always surrounds is also always surrounded by one of a word more
    inner = [F.expr(f"substring_index(phrase, ' ', {count})") for count in ("words - 1", "1 - words")]
    always = longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("n").alias("a"))
    whole = (mined.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
             .join(always, ["lang", "phrase", "a"], "left_anti"))
    cut = (whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
           .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
           .withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)")))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cut = cut_lineage(cut.join(part("first", "l"), ["lang", "first"])).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # 38 digits hold the products of counts below 10^15
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = (cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
            .select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score"))
    ranked = top_n_per_group(best, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
