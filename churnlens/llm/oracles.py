"""DuckDB SQL for the corpus queries that SQL can express (null texts count as empty)."""

from .license_scan import TEMPLATES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {}

SQL["op10_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

SQL["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS v
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT doc_id, w, lens.n, unnest(generate_series(1, len(w) - lens.n + 1)) AS i FROM d, lens)),
found AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN win ON p.v = win.v AND p.n = win.n),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM found) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hits.n_hit, 0) AS n_hit,
       coalesce(its.n_items, 0) AS n_items, coalesce(its.h, sha256('')) AS items_sha256,
       hits.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


def _license_sql() -> str:
    words = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    rows = []
    for number, t in enumerate(TEMPLATES):
        (_, one), (at2, two) = (t.placed() * 2)[:2]
        rows.append(f"({number}, '{t.label}', {t.base}, {words(one)}, {at2}, {words(two)}, {words(t.passage.split())})")
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t(number, label, base, one, at2, two, passage) AS (VALUES {", ".join(rows)}),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
found AS (
  SELECT doc_id, i - 1 AS start, label, base,
         len(list_filter(generate_series(1, len(passage)), lambda k: w[i + k - 1] = passage[k])) / len(passage) AS score
  FROM p JOIN t ON p.w[p.i] = t.one[1]
  WHERE w[i:i + len(one) - 1] = one AND w[i + at2:i + at2 + len(two) - 1] = two),
g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
         max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found WHERE score >= 0.6 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n_base, 0) AS n_base, g.first_word, g.last_word,
       coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, coalesce(g.score, 0.0) AS score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL["op1_license_scan"] = _license_sql()

SQL["op2_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(regexp_extract_all(text, '[0-9A-Za-z]+|[^0-9A-Za-z\x00-\x20]')) + 4 AS tok,
    length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g'))
    + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '<\n>'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g'))
    + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars
  FROM c),
o AS (
  SELECT *, row_number() OVER w - 1 AS idx, sum(tok) OVER w - tok AS before, first_value(role) OVER w AS role0,
    first_value(tok) OVER w AS tok0, first_value(chars) OVER w AS chars0, max(tok) OVER (PARTITION BY conv_id) AS most
  FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (
  SELECT *, before // greatest(1024 - 192 - CASE WHEN role0 = 'system' THEN tok0 ELSE 0 END - least(most, 512), 256) AS span FROM o),
sp AS (
  SELECT conv_id, span, min(idx) AS first, lead(min(idx)) OVER n AS next_first, lead(min(before)) OVER n AS next_start,
    max(CASE WHEN role0 = 'system' THEN chars0 END) AS sys_chars
  FROM s GROUP BY conv_id, span WINDOW n AS (PARTITION BY conv_id ORDER BY span)),
extra AS (
  SELECT s.conv_id, sum(s.chars) AS chars FROM s JOIN sp ON s.conv_id = sp.conv_id AND s.span = sp.span
  WHERE sp.next_start - s.before <= 192 AND sp.next_first - s.idx <= 2 AND NOT (s.idx = 0 AND sp.sys_chars IS NOT NULL)
  GROUP BY s.conv_id),
again AS (SELECT conv_id, sum(sys_chars) AS chars FROM sp WHERE first > 0 AND sys_chars IS NOT NULL GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '') AS target, sum(chars) AS chars
  FROM s GROUP BY conv_id)
SELECT g.conv_id, g.n_turns, g.turns_sha256, length(g.target) AS loss_chars, sha256(g.target) AS loss_sha256,
  CAST(g.chars + coalesce(extra.chars, 0) + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM g LEFT JOIN extra ON g.conv_id = extra.conv_id LEFT JOIN again ON g.conv_id = again.conv_id
"""

SQL["op11_source_audit"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM p GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, kept.term, count(p.term) AS n FROM g JOIN kept ON g.lang = kept.lang
  LEFT JOIN p ON p.lang = g.lang AND p.source = g.source AND p.term = kept.term GROUP BY g.lang, g.source, kept.term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
s AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (t.total + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 5)) // (v.total + 5 * v.v) AS q
  FROM c JOIN t ON c.lang = t.lang AND c.source = t.source JOIN v ON c.lang = v.lang
  JOIN kept ON c.lang = kept.lang AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

# all labelled documents are the target: the bound of the labelled ids is beyond these tables
SQL["op12_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT row, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS trusted FROM d),
h AS (
  SELECT row, i, CAST('0x' || left(md5(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 8) AS BIGINT) AS h
  FROM (SELECT row, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM w)),
grams AS (
  SELECT row, h % 65536 AS b FROM h
  UNION ALL SELECT x.row, (31 * x.h + y.h + 1) % 65536 FROM h x JOIN h y ON x.row = y.row AND y.i = x.i + 1),
bucket AS (SELECT b, count(*) AS raw, count(*) FILTER (trusted) AS target FROM grams JOIN w ON grams.row = w.row GROUP BY b),
sums AS (SELECT sum(raw) AS raw, sum(target) AS target FROM bucket),
weight AS (
  SELECT b, CASE WHEN sums.target = 0 THEN 0 ELSE CAST(floor(1000 * ln((bucket.target + 1.0::DOUBLE) / (bucket.raw + 1.0::DOUBLE)
    * ((sums.raw + 65536.0::DOUBLE) / (sums.target + 65536.0::DOUBLE)))) AS BIGINT) END AS x
  FROM bucket, sums),
llr AS (SELECT row, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS llr FROM grams JOIN weight ON grams.b = weight.b GROUP BY row),
tri AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM (
    SELECT row, w[i:i + 2] AS g, i FROM (SELECT row, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w))),
rep AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM tri WHERE n > 1) GROUP BY row),
lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (
  SELECT w.row, doc_id, trusted, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, llr.llr
  FROM w LEFT JOIN lines ON w.row = lines.row LEFT JOIN rep ON w.row = rep.row LEFT JOIN llr ON w.row = llr.row),
least AS (
  SELECT min(llr) FILTER (place > floor(0.001::DOUBLE * n)) - 60 AS least_llr
  FROM (SELECT llr, row_number() OVER (ORDER BY llr) AS place, count(*) OVER () AS n FROM m WHERE trusted AND n_words >= 50))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (least_llr IS NULL OR coalesce(llr >= least_llr, false)) AS kept, llr, least_llr
FROM m, least
"""

SQL["op13_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, g[1:k - 1] AS g, f FROM f WHERE k > 2 UNION SELECT lang, g[2:k] AS g, f FROM f WHERE k > 2),
c AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.lang = f.lang AND inner_.g = f.g AND inner_.f = f.f)),
cuts AS (SELECT lang, g, f AS a, k, unnest(generate_series(1, k - 1)) AS j FROM c),
s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, total.n, (1000::HUGEINT * a * total.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:j] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[j + 1:cuts.k]
  JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
