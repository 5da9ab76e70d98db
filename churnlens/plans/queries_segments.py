"""Stage-3 queries (churn-reason segments) and the dashboard pages over churned rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as RP
from ..operators import segments as SG
from ..operators.cleaning import q
from ..sources import files
from . import extract
from .oracle_model import ROW_ID_SQL, stage2
from ..operators.cohort import WIDE_COLUMNS
from .queries_cohort import cohort_frame, wide_frame
from .queries_labels import label_rows, sql as label_sql
from .registry import register
from .stages import remembered
from ..session import cut_lineage

_strip = "regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
_unknown = "CASE WHEN {s} IS NULL OR {s} IN ('', 'nan', 'None') THEN 'Unknown' ELSE {s} END"
PROFILE_SQL = "concat_ws(' ', " + ", ".join(_unknown.format(s=_strip.format(c=c)) for c in SG.TEXT_FEATURES) + ")"
REASON_SQL = _strip.format(c="SWAT_CANCEL_SUMMARY")

SEG_CTE = f"""
churn AS (
  SELECT *, {ROW_ID_SQL} AS row_id FROM clean WHERE CHURN_OR_RETAIN = 'Churn'
),
seg_in AS (
  SELECT * REPLACE ({REASON_SQL} AS SWAT_CANCEL_SUMMARY) FROM churn
  WHERE {REASON_SQL} IS NOT NULL AND {REASON_SQL} <> ''
)"""


def seg_sql(body: str, *extra: str) -> str:
    return stage2(body, SEG_CTE, *extra)


# --------------------------------------------------------------------- stage pieces
def churn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The churn-only stage-1 export, with the row id it was given there."""
    return extract.churn_cohort(cohort_frame(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a cancel summary, their embedding and reason segment.

    Only (row_id, embedding) is written before KMeans (it passes over its
    input every iteration) and only (row_id, embedding, segment) after it;
    the row's other columns, whole texts included, are joined back from the
    written cohort by key instead of being written again.
    """
    def build():
        base = SG.segment_input(churn_rows(spark, sf_dir))
        emb = cut_lineage(SG.embed(base).select("row_id", "embedding"))
        out, centres = SG.cluster(emb)
        return cut_lineage(out), centres
    labels, _ = remembered(spark, sf_dir, "segments", build)
    return SG.segment_input(churn_rows(spark, sf_dir), check_empty=False).join(labels, "row_id")


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written (row_id, embedding, reason_segment) table."""
    labelled(spark, sf_dir)  # builds and remembers it
    return remembered(spark, sf_dir, "segments", lambda: None)[0]


def _centres(spark, sf_dir):
    labelled(spark, sf_dir)
    return remembered(spark, sf_dir, "segments", lambda: None)[1]


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All churn rows with their reason segment (null where there is no summary)."""
    return SG.augment_with_segment(churn_rows(spark, sf_dir), segment_labels(spark, sf_dir))


# Segment reports are checked on a segmentation that SQL can state: rows with a
# cancel summary by tenure, 1, 2 and 3 or more months.
GIVEN_CTE = f"""
seg AS (SELECT *, CAST(CASE WHEN {REASON_SQL} <> '' THEN least(LIFETIME_MONTHS, 3) END AS INTEGER) AS reason_segment FROM churn),
given AS (SELECT * REPLACE ({REASON_SQL} AS SWAT_CANCEL_SUMMARY) FROM seg WHERE reason_segment IS NOT NULL)"""


def given_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a cancel summary and their tenure segment."""
    rows = SG.segment_input(churn_rows(spark, sf_dir))
    return rows.withColumn(SG.SEGMENT, F.least("LIFETIME_MONTHS", F.lit(3)).cast("int"))


def given_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All churn rows with their tenure segment."""
    return SG.augment_with_segment(churn_rows(spark, sf_dir), given_segments(spark, sf_dir))


# --------------------------------------------------------------------- text preparation
@register("segment_input", seg_sql(
    "SELECT row_id, md5(SWAT_CANCEL_SUMMARY) AS summary_md5, length(SWAT_CANCEL_SUMMARY) AS summary_chars "
    "FROM seg_in"))
def q_segment_input(spark, sf_dir):
    s = SG.segment_input(churn_rows(spark, sf_dir))
    return s.select("row_id", F.md5(q(SG.REASON_COLUMN)).alias("summary_md5"),
                    F.length(q(SG.REASON_COLUMN)).cast("long").alias("summary_chars"))


@register("compose_profile_text", seg_sql(f"SELECT row_id, {PROFILE_SQL} AS profile_text FROM seg_in"))
def q_compose_profile_text(spark, sf_dir):
    s = SG.segment_input(churn_rows(spark, sf_dir))
    return s.select("row_id", SG.profile_text(s).alias("profile_text"))


@register("normalise_text", seg_sql("SELECT row_id, " + ", ".join(
    f"{_unknown.format(s=_strip.format(c=c))} AS {c}" for c in SG.TEXT_FEATURES) + " FROM churn"))
def q_normalise_text(spark, sf_dir):
    c = SG.normalise_text(churn_rows(spark, sf_dir))
    return c.select("row_id", *SG.TEXT_FEATURES)


# --------------------------------------------------------------------- embeddings, clusters, PCA
@register("profile_embeddings")
def q_profile_embeddings(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return lab.select("row_id", vector_to_array("embedding").alias("embedding"))


@register("reason_segments", seg_sql(
    "SELECT count(*) AS n_rows, least(3, count(*)) AS n_segments, CAST(0 AS BIGINT) AS not_nearest FROM seg_in"))
def q_reason_segments(spark, sf_dir):
    """Invariants of the clustering: every row labelled, k segments, each row at its nearest centre."""
    lab = labelled(spark, sf_dir)
    centres = _centres(spark, sf_dir)
    return lab.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(SG.SEGMENT).alias("n_segments"),
                   SG.nearest_centre_violations(lab, centres).alias("not_nearest"))


_DIMS = SG.PROFILE_DIM + SG.REASON_DIM
_TOKENS = "list_filter(regexp_split_to_array(lower({t}), '[^0-9A-Za-z_]+'), lambda w: w <> '')"
_BUCKET = "CAST('0x' || left(md5(w), 8) AS BIGINT) % {dim}"


def _vector_sql(text: str, dim: int) -> str:
    counts = f"list_transform(range(0, {dim}), lambda d: len(list_filter(list_transform({_TOKENS.format(t=text)}, lambda w: {_BUCKET.format(dim=dim)}), lambda b: b = d)))"
    return counts


EMB_CTE = f"""
counted AS (
  SELECT row_id, {_vector_sql(PROFILE_SQL, SG.PROFILE_DIM)} AS a, {_vector_sql('SWAT_CANCEL_SUMMARY', SG.REASON_DIM)} AS b FROM seg_in),
unit AS (
  SELECT row_id, list_concat(list_transform(a, lambda n: CASE WHEN na > 0 THEN n / na ELSE 0.0::DOUBLE END),
                             list_transform(b, lambda n: CASE WHEN nb > 0 THEN n / nb ELSE 0.0::DOUBLE END)) AS v
  FROM (SELECT *, sqrt(CAST(list_sum(list_transform(a, lambda n: n * n)) AS DOUBLE)) AS na,
               sqrt(CAST(list_sum(list_transform(b, lambda n: n * n)) AS DOUBLE)) AS nb FROM counted) t)"""

# the same seeds and rounds, one row a coordinate; 60 rounds are far beyond the last move
LLOYD_CTE = f"""
x AS (SELECT row_id, unnest(range(0, {_DIMS})) AS d, CAST(floor(unnest(v) * {SG.FIXED} + 0.5) AS BIGINT) AS v FROM unit),
u AS (
  SELECT row_id, j, (CAST('0x' || left(md5(row_id || '|{SG.SEED}|' || j), 12) AS BIGINT) + 1) / CAST({1 << 48} AS DOUBLE) AS u
  FROM unit, (SELECT unnest([0, 1, 2]) AS j) t),
s0 AS (SELECT row_id FROM u WHERE j = 0 ORDER BY -ln(u), row_id LIMIT 1),
d0 AS (SELECT x.row_id, sum((x.v - c.v) * (x.v - c.v)) AS w FROM x JOIN x c ON x.d = c.d WHERE c.row_id = (SELECT row_id FROM s0) GROUP BY x.row_id),
s1 AS (SELECT d0.row_id FROM d0 JOIN u ON u.row_id = d0.row_id AND j = 1 WHERE w > 0 ORDER BY -ln(u) / w, d0.row_id LIMIT 1),
d1 AS (
  SELECT x.row_id, least(max(d0.w), sum((x.v - c.v) * (x.v - c.v))) AS w FROM x JOIN x c ON x.d = c.d JOIN d0 ON d0.row_id = x.row_id
  WHERE c.row_id = (SELECT row_id FROM s1) GROUP BY x.row_id),
s2 AS (SELECT d1.row_id FROM d1 JOIN u ON u.row_id = d1.row_id AND j = 2 WHERE w > 0 ORDER BY -ln(u) / w, d1.row_id LIMIT 1),
lloyd AS (
  SELECT 0 AS step, k, x.d, x.v
  FROM x JOIN (SELECT 0 AS k, row_id FROM s0 UNION ALL SELECT 1, row_id FROM s1 UNION ALL SELECT 2, row_id FROM s2) s ON s.row_id = x.row_id
  UNION ALL
  SELECT near.step + 1, near.k, x.d, CAST(sum(x.v) // count(*) AS BIGINT)
  FROM (SELECT step, row_id, min(struct_pack(dist := dist, k := k)).k AS k
        FROM (SELECT l.step, x.row_id, l.k, sum((x.v - l.v) * (x.v - l.v)) AS dist FROM x JOIN lloyd l ON x.d = l.d
              WHERE l.step < 60 GROUP BY l.step, x.row_id, l.k) g GROUP BY step, row_id) near
  JOIN x ON x.row_id = near.row_id GROUP BY near.step, near.k, x.d),
final AS (SELECT k, d, v FROM lloyd WHERE step = (SELECT max(step) FROM lloyd)),
own AS (
  SELECT row_id, min(struct_pack(dist := dist, k := k)).k AS k
  FROM (SELECT x.row_id, f.k, sum((x.v - f.v) * (x.v - f.v)) AS dist FROM x JOIN final f ON x.d = f.d GROUP BY x.row_id, f.k) g GROUP BY row_id),
named AS (
  SELECT k, CAST(row_number() OVER (ORDER BY n DESC, c) AS INTEGER) AS label
  FROM (SELECT k, count(*) AS n FROM own GROUP BY k) a JOIN (SELECT k, list(v ORDER BY d) AS c FROM final GROUP BY k) b USING (k))"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@register("embedding_coordinates", seg_sql(
    f"SELECT row_id, CAST(unnest(range(0, {_DIMS})) AS INTEGER) AS d, round(unnest(v), 9) AS v FROM unit", EMB_CTE))
def q_embedding_coordinates(spark, sf_dir):
    """Every coordinate of the default text vectors."""
    lab = labelled(spark, sf_dir).select("row_id", F.posexplode(vector_to_array("embedding")).alias("d", "v"))
    return lab.select("row_id", "d", F.round("v", 9).alias("v"))


@register("segment_labels", _recursive(seg_sql("SELECT own.row_id, label AS reason_segment FROM own JOIN named USING (k)", EMB_CTE, LLOYD_CTE)))
def q_segment_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("row_id", SG.SEGMENT)


@register("segment_sizes", seg_sql("""
SELECT reason_segment AS segment, count(*) AS size, (SELECT count(DISTINCT reason_segment) FROM given) AS n_segments,
       (SELECT count(*) FROM given) AS total,
       CAST((SELECT count(*) FROM given) AS DOUBLE) / (SELECT count(DISTINCT reason_segment) FROM given) AS avg_size
FROM given GROUP BY 1""", GIVEN_CTE))
def q_segment_sizes(spark, sf_dir):
    return RP.segment_sizes(given_segments(spark, sf_dir), SG.SEGMENT).withColumns(
        {"n_segments": F.col("n_segments").cast("long"), "total": F.col("total").cast("long")})


@register("segment_order", seg_sql("""
SELECT CAST(row_number() OVER (ORDER BY reason_segment) AS BIGINT) AS position, reason_segment AS segment FROM (SELECT DISTINCT reason_segment FROM given) t""", GIVEN_CTE))
def q_segment_order(spark, sf_dir):
    """The sorted list of segments: one row a segment, with its place."""
    s = RP.segment_sizes(given_segments(spark, sf_dir), SG.SEGMENT)
    return RP.with_position(s.select("segment"))


@register("segment_totals", seg_sql("""
SELECT count(DISTINCT reason_segment) AS n_segments, count(*) AS total,
       round(CAST(count(*) AS DOUBLE) / count(DISTINCT reason_segment), 6) AS avg_size FROM given""", GIVEN_CTE))
def q_segment_totals(spark, sf_dir):
    s = RP.segment_sizes(given_segments(spark, sf_dir), SG.SEGMENT)
    return s.select(F.col("n_segments").cast("long").alias("n_segments"), F.col("total").cast("long").alias("total"),
                    F.round("avg_size", 6).alias("avg_size")).distinct()


@register("pca_projection")
def q_pca_projection(spark, sf_dir):
    return SG.pca_2d(labelled(spark, sf_dir)).select("row_id", SG.SEGMENT, "pc1", "pc2")


@register("pca_invariants", seg_sql(
    "SELECT count(*) AS n_rows, CAST(0.0 AS DOUBLE) AS mean_pc1, CAST(0.0 AS DOUBLE) AS mean_pc2, "
    "true AS pc1_var_ge_pc2 FROM seg_in"))
def q_pca_invariants(spark, sf_dir):
    """Projections are centred and the first component carries the most variance."""
    p = SG.pca_2d(labelled(spark, sf_dir))
    return p.agg(F.count(F.lit(1)).alias("n_rows"),
                 (F.round(F.avg("pc1"), 6) + 0.0).alias("mean_pc1"), (F.round(F.avg("pc2"), 6) + 0.0).alias("mean_pc2"),
                 (F.var_pop("pc1") >= F.var_pop("pc2") - 1e-12).alias("pc1_var_ge_pc2"))


_PLANE = "word_length * 10 AS x, n_lines AS y"


@register("pca_plane", label_sql("""
SELECT row_id, round(abs(cos(th) * (x - mx) + sin(th) * (y - my)), 6) AS abs_pc1,
       round(abs(cos(th) * (y - my) - sin(th) * (x - mx)), 6) AS abs_pc2
FROM xy, (SELECT *, 0.5 * atan2(2 * cxy, vx - vy) AS th FROM (
  SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM xy) m) t""",
          f"xy AS (SELECT row_id, {_PLANE} FROM v)"))
def q_pca_plane(spark, sf_dir):
    """Both components of plane vectors, up to sign, against the angle of the covariance ellipse."""
    rows = label_rows(spark, sf_dir).select("row_id", array_to_vector(F.array(F.col("word_length") * 10, "n_lines")).alias("embedding"))
    p = SG.pca_2d(rows)
    return p.select("row_id", F.round(F.abs("pc1"), 6).alias("abs_pc1"), F.round(F.abs("pc2"), 6).alias("abs_pc2"))


@register("augment_with_segment", seg_sql("SELECT row_id, reason_segment FROM seg", GIVEN_CTE))
def q_augment_with_segment(spark, sf_dir):
    return given_augmented(spark, sf_dir).select("row_id", SG.SEGMENT)


# --------------------------------------------------------------------- segment text tables
_md_cells = " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in SG.SUMMARY_COLUMNS)
_md_header = "| " + " | ".join(SG.SUMMARY_COLUMNS) + " |"
_md_sep = "| " + " | ".join("-" * len(c) for c in SG.SUMMARY_COLUMNS) + " |"


@register("industry_markdown", seg_sql(f"""
SELECT CORE_INDUSTRY, line_no, md5(line) AS line_md5, length(line) AS line_chars FROM (
  SELECT DISTINCT CORE_INDUSTRY, CAST(0 AS BIGINT) AS line_no, '{_md_header}' AS line FROM seg_in
  UNION ALL SELECT DISTINCT CORE_INDUSTRY, 1, '{_md_sep}' FROM seg_in
  UNION ALL SELECT CORE_INDUSTRY, row_number() OVER (PARTITION BY CORE_INDUSTRY ORDER BY row_id) + 1,
         '| ' || {_md_cells} || ' |' FROM seg_in) t"""))
def q_industry_markdown(spark, sf_dir):
    """Markdown tables of the summary columns per industry (one row per line)."""
    s = SG.segment_input(churn_rows(spark, sf_dir))
    md = SG.markdown_lines(s, "CORE_INDUSTRY")
    return md.select("CORE_INDUSTRY", F.col("line_no").cast("long").alias("line_no"),
                     F.md5("line").alias("line_md5"), F.length("line").cast("long").alias("line_chars"))


@register("segment_markdown", seg_sql(f"""
SELECT reason_segment, line_no, md5(line) AS line_md5 FROM (
  SELECT DISTINCT reason_segment, CAST(0 AS BIGINT) AS line_no, '{_md_header}' AS line FROM given
  UNION ALL SELECT DISTINCT reason_segment, 1, '{_md_sep}' FROM given
  UNION ALL SELECT reason_segment, row_number() OVER (PARTITION BY reason_segment ORDER BY row_id) + 1,
         '| ' || {_md_cells} || ' |' FROM given) t""", GIVEN_CTE))
def q_segment_markdown(spark, sf_dir):
    """The per-segment extract: one markdown table a segment, one row a line."""
    md = SG.markdown_lines(given_segments(spark, sf_dir), SG.SEGMENT)
    return md.select(SG.SEGMENT, F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


@register("segment_examples", seg_sql("""
SELECT reason_segment, example, LOCATION_NAME, CORE_INDUSTRY, STARTING_BUNDLE, LIFETIME_MONTHS, PRACTICE_MANAGEMENT_SOFTWARE,
       md5(substr(SWAT_CANCEL_SUMMARY, 1, 200)) AS excerpt_md5
FROM (SELECT *, row_number() OVER (PARTITION BY reason_segment ORDER BY row_id) AS example FROM given) t WHERE example <= 3""",
          GIVEN_CTE))
def q_segment_examples(spark, sf_dir):
    ex = SG.segment_examples(given_segments(spark, sf_dir), SG.SEGMENT)
    return ex.select(SG.SEGMENT, F.col("example").cast("long").alias("example"), "LOCATION_NAME", "CORE_INDUSTRY", "STARTING_BUNDLE",
                     "LIFETIME_MONTHS", "PRACTICE_MANAGEMENT_SOFTWARE", F.md5("reason_excerpt").alias("excerpt_md5"))


@register("industry_examples", seg_sql("""
SELECT CORE_INDUSTRY, example, LOCATION_NAME, md5(substr(SWAT_CANCEL_SUMMARY, 1, 200)) AS excerpt_md5
FROM (SELECT *, row_number() OVER (PARTITION BY CORE_INDUSTRY ORDER BY row_id) AS example FROM churn) t
WHERE example <= 3"""))
def q_industry_examples(spark, sf_dir):
    """First three churned rows per industry with a 200-character reason excerpt."""
    ex = SG.segment_examples(churn_rows(spark, sf_dir), "CORE_INDUSTRY")
    return ex.select("CORE_INDUSTRY", F.col("example").cast("long").alias("example"), "LOCATION_NAME",
                     F.md5("reason_excerpt").alias("excerpt_md5"))


# --------------------------------------------------------------------- dashboard pages over churned rows
_TOP_COLS = ["CORE_INDUSTRY", "STARTING_BUNDLE", "PRACTICE_MANAGEMENT_SOFTWARE"]


@register("top_values_pct", seg_sql("\nUNION ALL\n".join(f"""
SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM churn), 1) AS pct
  FROM churn WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, value LIMIT 5)""" for c in _TOP_COLS)))
def q_top_values_pct(spark, sf_dir):
    return RP.top_values_pct(augmented(spark, sf_dir), _TOP_COLS, 5)


@register("tenure_revenue_summary", seg_sql("""
SELECT avg(LIFETIME_MONTHS) AS avg_tenure, CAST(median(LIFETIME_MONTHS) AS DOUBLE) AS median_tenure,
       round(avg(STARTING_MRR), 6) AS avg_revenue, sum(STARTING_MRR) AS total_revenue FROM churn"""))
def q_tenure_revenue_summary(spark, sf_dir):
    s = RP.tenure_revenue_summary(augmented(spark, sf_dir), "LIFETIME_MONTHS", "STARTING_MRR")
    return s.select("avg_tenure", F.col("median_tenure").cast("double"),
                    F.round(F.col("avg_revenue").cast("double"), 6).alias("avg_revenue"), "total_revenue")


_theme_sql = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS theme, CAST(count_if(" + " OR ".join(
        f"contains(lower(SWAT_CANCEL_SUMMARY), '{w}')" for w in words) + ") AS BIGINT) AS customers FROM churn"
    for name, words in RP.THEMES.items())


@register("pain_point_themes", seg_sql(_theme_sql))
def q_pain_point_themes(spark, sf_dir):
    return RP.theme_counts(augmented(spark, sf_dir), "SWAT_CANCEL_SUMMARY")


PROFILE_CTE = """
top AS (SELECT CORE_INDUSTRY AS grp, count(*) AS customers FROM churn WHERE CORE_INDUSTRY IS NOT NULL
        GROUP BY 1 ORDER BY customers DESC, grp LIMIT 4),
base AS (SELECT * FROM churn WHERE CORE_INDUSTRY IN (SELECT grp FROM top))"""


@register("industry_profiles", seg_sql("""
SELECT grp AS industry, 'summary' AS kind, 0 AS rank,
       'avg_mrr=' || CAST(CAST(round(CAST(avg_mrr AS DOUBLE), 2) AS DECIMAL(38,2)) AS VARCHAR)
         || ' avg_tenure=' || CAST(CAST(round(CAST(avg_tenure AS DOUBLE), 2) AS DECIMAL(38,2)) AS VARCHAR) AS value,
       customers AS count
FROM top JOIN (SELECT CORE_INDUSTRY AS g, avg(STARTING_MRR) AS avg_mrr, avg(LIFETIME_MONTHS) AS avg_tenure
               FROM base GROUP BY 1) s ON s.g = top.grp
UNION ALL
SELECT grp, 'pms', rank, value, count FROM (
  SELECT CORE_INDUSTRY AS grp, PRACTICE_MANAGEMENT_SOFTWARE AS value, count(*) AS count,
         row_number() OVER (PARTITION BY CORE_INDUSTRY ORDER BY count(*) DESC, PRACTICE_MANAGEMENT_SOFTWARE) AS rank
  FROM base WHERE PRACTICE_MANAGEMENT_SOFTWARE IS NOT NULL GROUP BY 1, 2) t WHERE rank <= 3
UNION ALL
SELECT grp, 'bundle', rank, value, count FROM (
  SELECT CORE_INDUSTRY AS grp, STARTING_BUNDLE AS value, count(*) AS count,
         row_number() OVER (PARTITION BY CORE_INDUSTRY ORDER BY count(*) DESC, STARTING_BUNDLE) AS rank
  FROM base WHERE STARTING_BUNDLE IS NOT NULL GROUP BY 1, 2) t WHERE rank <= 2""", PROFILE_CTE))
def q_industry_profiles(spark, sf_dir):
    p = RP.industry_profiles(augmented(spark, sf_dir), "CORE_INDUSTRY", "PRACTICE_MANAGEMENT_SOFTWARE",
                             "STARTING_BUNDLE", "STARTING_MRR", "LIFETIME_MONTHS")
    return p.withColumn("rank", F.col("rank").cast("long"))


_top_sql = "\nUNION ALL\n".join(f"""
SELECT * FROM (SELECT 'top_{c}', CAST({c} AS VARCHAR), format('{{}} customers ({{:.1f}}%)', count(*),
       round(count(*) * 100.0 / (SELECT count(*) FROM seg), 1)) FROM seg WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 5)"""
                                for c in _TOP_COLS)
_pain_sql = "\nUNION ALL\n".join(
    f"SELECT 'pain_point', '{name}', count_if(" + " OR ".join(f"contains(lower(SWAT_CANCEL_SUMMARY), '{w}')" for w in words)
    + ") || ' customers' FROM seg" for name, words in RP.THEMES.items())


@register("segment_report", seg_sql(f"""
SELECT 'overview' AS section, 'segments' AS key, CAST(count(DISTINCT reason_segment) AS VARCHAR) AS value FROM given
UNION ALL SELECT 'overview', 'customers', format('{{:,}}', count(*)) FROM given
UNION ALL SELECT 'overview', 'average size', format('{{:.0f}}', round(CAST(count(*) AS DOUBLE) / count(DISTINCT reason_segment))) FROM given
UNION ALL SELECT 'segment', CAST(reason_segment AS VARCHAR), count(*) || ' customers' FROM given GROUP BY reason_segment
UNION ALL SELECT 'tenure', 'average', format('{{:.1f}} months', round(avg(LIFETIME_MONTHS), 1)) FROM seg
UNION ALL SELECT 'tenure', 'median', format('{{:.1f}} months', round(median(LIFETIME_MONTHS), 1)) FROM seg
UNION ALL SELECT 'revenue', 'average', format('${{:,.2f}}', round(avg(CAST(STARTING_MRR AS DOUBLE)), 2)) FROM seg
UNION ALL SELECT 'revenue', 'total', format('${{:,.2f}}', CAST(sum(STARTING_MRR) AS DOUBLE)) FROM seg
UNION ALL SELECT 'example', reason_segment || '.' || n, LOCATION_NAME || ' (' || CORE_INDUSTRY || ') - '
    || format('${{:.0f}} MRR, ', round(CAST(STARTING_MRR AS DOUBLE))) || LIFETIME_MONTHS || ' months, ' || PRACTICE_MANAGEMENT_SOFTWARE || ' PMS'
  FROM (SELECT *, row_number() OVER (PARTITION BY reason_segment ORDER BY row_id) AS n FROM given) t WHERE n <= 3
UNION ALL SELECT 'reason', reason_segment || '.' || n, substr(SWAT_CANCEL_SUMMARY, 1, 200) || '...'
  FROM (SELECT *, row_number() OVER (PARTITION BY reason_segment ORDER BY row_id) AS n FROM given) t WHERE n <= 3
UNION ALL SELECT 'industry', upper(grp), customers || ' customers' FROM top
UNION ALL SELECT 'industry_average', upper(CORE_INDUSTRY), format('${{:.0f}} MRR, {{:.1f}} months', round(avg(CAST(STARTING_MRR AS DOUBLE))),
    round(avg(LIFETIME_MONTHS), 1)) FROM base GROUP BY CORE_INDUSTRY
UNION ALL SELECT 'industry_pms', upper(grp) || ' ' || rank, value || ' (' || count || ')' FROM (
  SELECT CORE_INDUSTRY AS grp, PRACTICE_MANAGEMENT_SOFTWARE AS value, count(*) AS count,
         row_number() OVER (PARTITION BY CORE_INDUSTRY ORDER BY count(*) DESC, PRACTICE_MANAGEMENT_SOFTWARE) AS rank
  FROM base WHERE PRACTICE_MANAGEMENT_SOFTWARE IS NOT NULL GROUP BY 1, 2) t WHERE rank <= 3
UNION ALL SELECT 'industry_bundle', upper(grp) || ' ' || rank, value FROM (
  SELECT CORE_INDUSTRY AS grp, STARTING_BUNDLE AS value,
         row_number() OVER (PARTITION BY CORE_INDUSTRY ORDER BY count(*) DESC, STARTING_BUNDLE) AS rank
  FROM base WHERE STARTING_BUNDLE IS NOT NULL GROUP BY 1, 2) t WHERE rank <= 2
UNION ALL {_top_sql}
UNION ALL {_pain_sql}""", GIVEN_CTE, PROFILE_CTE))
def q_segment_report(spark, sf_dir):
    """The assistant context as a table: (section, key, value) lines of every part of the report."""
    return RP.context_report(given_augmented(spark, sf_dir), given_segments(spark, sf_dir), SG.SEGMENT, _TOP_COLS)


# --------------------------------------------------------------------- CSV sink and source
@register("csv_roundtrip", seg_sql(
    "SELECT row_id, md5(SWAT_CANCEL_SUMMARY) AS summary_md5 FROM seg_in"))
def q_csv_roundtrip(spark, sf_dir):
    """Labelled rows written as CSV (quoted multi-line text) to the shared folder, read back whole."""
    lab = labelled(spark, sf_dir).select("row_id", SG.REASON_COLUMN, SG.SEGMENT)
    path = files.export_path(spark, "segments_csv")
    files.write_csv(lab, path)
    back = files.read_csv(spark, path, "row_id STRING, SWAT_CANCEL_SUMMARY STRING, reason_segment INT")
    return back.select("row_id", F.md5(SG.REASON_COLUMN).alias("summary_md5"))


@register("column_catalog", seg_sql("\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS n_values FROM wide" for i, c in enumerate(WIDE_COLUMNS))))
def q_column_catalog(spark, sf_dir):
    """The column list of the wide row, with the values each column holds (one aggregate)."""
    from ..functions.columns import column_catalog
    wide = wide_frame(spark, sf_dir).drop("row_id")
    held = wide.agg(*[F.count(F.col(c)).alias(c) for c in wide.columns])
    held = held.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("n_values")) for c in wide.columns])).alias("h")).select("h.*")
    return column_catalog(wide).join(held, F.col("column_name") == F.col("_c")).select("position", "column_name", "n_values")


# Display columns of the segment detail page.
DETAIL_COLUMNS = ["LOCATION_NAME", "CORE_INDUSTRY", "PRACTICE_MANAGEMENT_SOFTWARE", "STARTING_BUNDLE",
                  "LIFETIME_MONTHS", "STARTING_MRR", "SWAT_CANCEL_SUMMARY", "reason_segment"]


def segment_detail(df: DataFrame, segment: int | None = None) -> DataFrame:
    """Rows of one segment (``None`` = all segments) with the display columns that exist."""
    out = df if segment is None else df.filter(F.col(SG.SEGMENT) == segment)
    present = set(out.columns)
    return out.select(*[c for c in DETAIL_COLUMNS if c in present])


@register("segment_detail", seg_sql(
    "SELECT LOCATION_NAME, CORE_INDUSTRY, PRACTICE_MANAGEMENT_SOFTWARE, STARTING_BUNDLE, LIFETIME_MONTHS, "
    "md5(SWAT_CANCEL_SUMMARY) AS summary_md5 FROM churn"))
def q_segment_detail(spark, sf_dir):
    """'All Segments' view of the detail page (every churned row)."""
    d = segment_detail(augmented(spark, sf_dir))
    return d.select("LOCATION_NAME", "CORE_INDUSTRY", "PRACTICE_MANAGEMENT_SOFTWARE", "STARTING_BUNDLE",
                    "LIFETIME_MONTHS", F.md5("SWAT_CANCEL_SUMMARY").alias("summary_md5"))


@register("segment_detail_one", seg_sql(
    "SELECT LOCATION_NAME, CORE_INDUSTRY, PRACTICE_MANAGEMENT_SOFTWARE, STARTING_BUNDLE, LIFETIME_MONTHS, "
    "CAST(STARTING_MRR AS DOUBLE) AS STARTING_MRR, reason_segment, md5(SWAT_CANCEL_SUMMARY) AS summary_md5 FROM seg "
    "WHERE reason_segment = 1", GIVEN_CTE))
def q_segment_detail_one(spark, sf_dir):
    """Detail rows of one segment, all display columns."""
    return segment_detail(given_augmented(spark, sf_dir), 1).withColumns(
        {"STARTING_MRR": F.col("STARTING_MRR").cast("double"), "summary_md5": F.md5("SWAT_CANCEL_SUMMARY")}).drop("SWAT_CANCEL_SUMMARY")


@register("csv_strings", seg_sql(
    "SELECT row_id, LOCATION_NAME, CORE_INDUSTRY, CAST(LIFETIME_MONTHS AS VARCHAR) AS LIFETIME_MONTHS, "
    "md5(SWAT_CANCEL_SUMMARY) AS summary_md5 FROM seg_in"))
def q_csv_strings(spark, sf_dir):
    """A CSV export read back with every column as a string (no type inference pass)."""
    cols = ["row_id", "LOCATION_NAME", "CORE_INDUSTRY", "LIFETIME_MONTHS", SG.REASON_COLUMN]
    src = SG.segment_input(churn_rows(spark, sf_dir)).select(*cols)
    path = files.export_path(spark, "churn_csv")
    files.write_csv(src, path)
    back = files.read_csv(spark, path)
    return back.select("row_id", "LOCATION_NAME", "CORE_INDUSTRY", "LIFETIME_MONTHS",
                       F.md5(SG.REASON_COLUMN).alias("summary_md5"))
