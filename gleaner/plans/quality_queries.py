"""Queries over quality checks, duplicates and validation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import quality
from gleaner.functions.text import normalise_question
from gleaner.operators import dedup, validation
from gleaner.operators.similar_text import similar_pairs
from gleaner.plans import inputs
from gleaner.plans.encoding import md5_encoder, md5_entries
from gleaner.plans.ratio_sql import ratios
from gleaner.plans.registry import PAIRS, query, sql_collapse, sql_strip, sql_words


def _any(text: str, phrases: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " + ".join(f"contains({text}, '{p}')::INT" for p in quoted) + ")"


def checks_of(rows: str) -> str:
    """CTEs that end in ``totals``: the checks of all questions and answers of ``rows``."""
    return f"""
measured AS (
  SELECT *, length(question) AS ql, length(answer) AS al,
    {sql_strip('question')} AS sq, {sql_strip('answer')} AS sa,
    {sql_words('lower(answer)')} AS w,
    {_any('lower(answer)', [p.lower() for p in quality.REFUSALS])} AS refusals,
    len(regexp_extract_all(answer, '(?i)\\[Evidence\\s*\\d+\\]|\\[Ref(?:erence)?\\s*\\d+\\]|\\[Source\\s*\\d+\\]|\\(\\s*Evidence\\s*\\d+\\s*\\)')) AS citations,
    {_any('lower(answer)', quality.SOURCE_PHRASES)} + {_any('lower(question)', quality.SOURCE_PHRASES)} AS sources
  FROM {rows}),
flags AS (
  SELECT *, ql BETWEEN 10 AND 500 AND al BETWEEN 20 AND 3000 AS length_ok,
    ((CASE WHEN ql BETWEEN 20 AND 200 THEN 1.0 WHEN ql BETWEEN 10 AND 500 THEN 0.7 ELSE 0.0 END)::DOUBLE
     + (CASE WHEN al BETWEEN 50 AND 1000 THEN 1.0 WHEN al BETWEEN 20 AND 3000 THEN 0.6 ELSE 0.0 END)::DOUBLE) / 2
      AS length_score,
    sq LIKE '%?' AS marked,
    regexp_matches(lower(sq), '^({'|'.join(quality.QUESTION_STARTERS)})') AS opened,
    len(w) > 10 AND len(list_distinct(w)) / len(w) < 0.25 AS repetitive,
    contains(left(upper(answer), 50), 'NOT FOUND') AS not_found,
    list_filter([CASE WHEN sq NOT LIKE '%?' THEN 'question_mark_missing' END,
      CASE WHEN length(sq) < 30 THEN 'question_short' END,
      CASE WHEN NOT regexp_matches(sa, '[.!?]$') THEN 'answer_end_missing' END,
      CASE WHEN length(sa) < 50 THEN 'answer_short' END,
      CASE WHEN (sq LIKE '%...' OR sq LIKE '%…') AND sq NOT LIKE '%....' THEN 'question_truncated' END,
      CASE WHEN (sa LIKE '%...' OR sa LIKE '%…') AND sa NOT LIKE '%....' THEN 'answer_truncated' END],
      lambda x: x IS NOT NULL) AS issues
  FROM measured),
scores AS (
  SELECT *, CASE WHEN marked AND opened THEN 1.0 WHEN marked OR opened THEN 0.7 ELSE 0.0 END::DOUBLE AS format_score,
    refusals = 0 AND citations = 0 AND NOT repetitive AS relevance_ok,
    greatest(0.0::DOUBLE, 1.0::DOUBLE - (refusals * 0.3::DOUBLE + (CASE WHEN citations > 0 THEN 0.4 ELSE 0 END)::DOUBLE
      + sources * 0.1::DOUBLE + (CASE WHEN repetitive THEN 0.3 ELSE 0 END)::DOUBLE)) AS relevance_score
  FROM flags),
totals AS (
  SELECT *, round((length_score * 0.25::DOUBLE + format_score * 0.2::DOUBLE + relevance_score * 0.3::DOUBLE)
    / 0.75::DOUBLE, 4) AS total FROM scores)
"""


CHECKS = f"WITH {PAIRS}, {checks_of('pairs')}"


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.evaluate_pairs(inputs.pairs(spark, sf_dir), 0.4)


def _of(check: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("checks")[check]
    return checked(spark, sf_dir).select(
        "id", c["passed"].alias("passed"), F.round(c["score"], 6).alias("score")
    )


@query(CHECKS + "SELECT id, length_ok AS passed, round(length_score, 6) AS score FROM scores")
def length_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(0, spark, sf_dir)


@query(CHECKS + "SELECT id, marked OR opened AS passed, round(format_score, 6) AS score FROM scores")
def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(1, spark, sf_dir)


@query(CHECKS + "SELECT id, relevance_ok AS passed, round(relevance_score, 6) AS score FROM scores")
def content_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(2, spark, sf_dir)


@query(CHECKS + """SELECT id, array_to_string(issues, ';') AS issues, len(issues) = 0 AS passed,
  round(greatest(0.0, 1.0 - len(issues) * 0.25), 6)::DOUBLE AS score FROM scores""")
def completeness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    c = quality.check_completeness(q, a)
    return inputs.pairs(spark, sf_dir).select(
        "id",
        F.array_join(quality.completeness_issues(q, a), ";").alias("issues"),
        c["passed"].alias("passed"),
        F.round(c["score"], 6).alias("score"),
    )


@query(CHECKS + "SELECT id, not_found FROM scores")
def not_found_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pairs(spark, sf_dir).select(
        "id", quality.is_not_found(F.col("answer")).alias("not_found")
    )


@query(CHECKS + """SELECT id, total AS quality_score,
  length_ok AND relevance_ok AND total >= 0.4 AS passed FROM totals""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("id", "quality_score", "passed")


@query(CHECKS + """SELECT id AS qa_pair_id, c.kind AS check_type, c.ok AS passed, round(c.score, 6) AS score
FROM (SELECT id, unnest([{'kind': 'length', 'ok': length_ok, 'score': length_score},
  {'kind': 'format', 'ok': marked OR opened, 'score': format_score},
  {'kind': 'relevance', 'ok': relevance_ok, 'score': relevance_score}]) AS c FROM scores)""")
def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        validation.check_rows(checked(spark, sf_dir), "id")
        .withColumn("score", F.round("score", 6))
        .drop("details")
    )


@query(f"""SELECT {sql_collapse('lower(text)')} AS text, count(*) AS copies, min(doc_id) AS first,
  max(doc_id) AS last FROM documents GROUP BY 1""")
def exact_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir)
    return dedup.exact_groups(docs, normalise_question(F.col("text")), "doc_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question, then once more reworded, then copied."""
    asked = inputs.table(spark, sf_dir, "conversations").filter("role = 'user'")
    at = F.col("conv_id") * 1000 + F.col("turn") * 10

    def variant(place: int, opening: str, ending: str) -> DataFrame:
        return asked.select(
            (at + place).alias("position"),
            F.concat(F.lit(opening), "text", F.lit(ending)).alias("question"),
        )

    return (
        variant(0, "What is ", "?")
        .unionByName(variant(1, "What was ", "?"))
        .unionByName(variant(2, "WHAT  is ", "?"))
    )


HELD = """nodes AS (SELECT min(pos) AS gid, text FROM held GROUP BY text),
held_as AS (SELECT h.pos, n.gid FROM held h JOIN nodes n USING (text))"""

QUESTIONS = f"""WITH RECURSIVE asked AS (
  SELECT conv_id * 1000 + turn * 10 AS pos, text FROM conversations WHERE role = 'user'),
questions AS (
  SELECT pos AS position, 'What is ' || text || '?' AS question FROM asked
  UNION ALL SELECT pos + 1, 'What was ' || text || '?' FROM asked
  UNION ALL SELECT pos + 2, 'WHAT  is ' || text || '?' FROM asked),
held AS (SELECT position AS pos, {sql_collapse('lower(question)')} AS text FROM questions),
{HELD}, {ratios('nodes')}
"""


def walk(nodes: str, edges: str) -> str:
    """CTEs that end in ``winners(id)``: nodes in the order of their id, the first wins."""
    return f"""
numbered AS MATERIALIZED (
  SELECT n.id, row_number() OVER (ORDER BY n.id) AS k,
    coalesce(list(e.earlier) FILTER (e.earlier IS NOT NULL), []) AS before
  FROM {nodes} n LEFT JOIN {edges} e ON e.later = n.id GROUP BY n.id),
walk AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
  UNION ALL
  SELECT n.k, CASE WHEN list_has_any(n.before, w.kept) THEN w.kept ELSE list_append(w.kept, n.id) END
  FROM walk w JOIN numbered n ON n.k = w.k + 1),
winners AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1))"""


@query(QUESTIONS + "SELECT earlier, later, ratio FROM ratios WHERE earlier < later")
def similar_question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir)
    nodes = dedup.exact_groups(rows, normalise_question(F.col("question")), "position")
    return similar_pairs(nodes.select(F.col("first").alias("gid"), "text"))


@query(QUESTIONS + """SELECT gid AS earlier, pos AS later, 1.0::DOUBLE AS similarity FROM held_as WHERE pos > gid
UNION ALL SELECT earlier, pos, ratio FROM held_as JOIN ratios ON later = gid WHERE pos > earlier""")
def question_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fuzzy_edges(questions(spark, sf_dir), "position", "question")


@query(f"""{QUESTIONS}, heads AS (SELECT gid AS id FROM nodes),
ahead AS MATERIALIZED (SELECT earlier, later FROM ratios WHERE earlier < later), {walk('heads', 'ahead')}
SELECT position, question FROM questions JOIN winners ON id = position""")
def deduplicated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_questions(questions(spark, sf_dir), "position", "question")


EDGES = """edges AS (
  SELECT a.vec_id AS earlier, b.vec_id AS later,
    list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35)"""


@query(f"WITH {EDGES} SELECT earlier, later, round(similarity, 6) AS similarity FROM edges")
def vector_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = inputs.table(spark, sf_dir, "embeddings")
    edges = dedup.semantic_edges(vectors, "vec_id", "embedding", 0.35)
    return edges.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {EDGES},
walk AS (
  SELECT -1::BIGINT AS k, []::BIGINT[] AS kept
  UNION ALL
  SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.later = w.k + 1
      AND list_contains(w.kept, e.earlier)) THEN w.kept ELSE list_append(w.kept, w.k + 1) END
  FROM walk w WHERE w.k < (SELECT max(vec_id) FROM embeddings))
SELECT unnest(kept) AS vec_id FROM walk WHERE k = (SELECT max(vec_id) FROM embeddings)""")
def deduplicated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = inputs.table(spark, sf_dir, "embeddings")
    return dedup.dedup_vectors(vectors, "vec_id", "embedding", 0.35).select("vec_id")


def to_validate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and a later reworded copy of each; the benchmark texts as seeds."""
    pairs = inputs.pairs(spark, sf_dir).select(
        (F.col("id") * 10).alias("position"), "question", "answer"
    )
    again = pairs.select(
        (F.col("position") + 1).alias("position"),
        F.replace("question", F.lit("What is "), F.lit("What was ")).alias("question"),
        "answer",
    )
    seeds = inputs.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("position"), F.col("text").alias("question")
    )
    return pairs.unionByName(again), seeds


WITH_DUPLICATE = """round((length_score * 0.25::DOUBLE + format_score * 0.2::DOUBLE + relevance_score * 0.3::DOUBLE
    + (1.0::DOUBLE - coalesce(similarity, 0)) * 0.25::DOUBLE) / 1.0::DOUBLE, 4)"""

CANDIDATES = """candidates AS (
  SELECT id * 10 AS position, question, answer FROM pairs
  UNION ALL SELECT id * 10 + 1, replace(question, 'What is ', 'What was '), answer FROM pairs)"""

VALIDATED = f"""WITH RECURSIVE {PAIRS}, {CANDIDATES}, {checks_of('candidates')},
staged AS MATERIALIZED (
  SELECT *, {sql_collapse('lower(question)')} AS text,
    CASE WHEN not_found THEN 0 WHEN len(issues) > 0 THEN 1 ELSE 2 END AS stage,
    length_ok AND relevance_ok AND {WITH_DUPLICATE} >= 0.4 AS good
  FROM (SELECT *, NULL::DOUBLE AS similarity FROM totals)),
seeds AS (SELECT {sql_collapse('lower(text)')} AS text, min(item_id) AS seed FROM benchmark GROUP BY 1),
nodes AS (SELECT text, row_number() OVER (ORDER BY text) AS gid
  FROM (SELECT text FROM staged WHERE stage = 2 UNION SELECT text FROM seeds)),
places AS (
  SELECT n.gid, n.text, any_value(s.seed) - 4611686018427387904 AS seeded,
    min(t.position) FILTER (t.stage = 2 AND t.good) AS lead
  FROM nodes n LEFT JOIN seeds s USING (text) LEFT JOIN staged t USING (text) GROUP BY n.gid, n.text),
{ratios('nodes')},
free AS (
  SELECT gid, text, lead AS id FROM places WHERE lead IS NOT NULL AND seeded IS NULL AND gid NOT IN (
    SELECT later FROM ratios JOIN places p ON p.gid = earlier WHERE p.seeded IS NOT NULL)),
entries AS {md5_entries('free', "string_split(text, ' ')")},
norms AS (SELECT gid, sqrt(sum(x * x)) AS norm FROM entries GROUP BY gid),
cosines AS (
  SELECT x.gid AS earlier, y.gid AS later FROM entries x JOIN entries y ON x.place = y.place AND x.gid <> y.gid
  JOIN norms a ON a.gid = x.gid JOIN norms b ON b.gid = y.gid
  GROUP BY x.gid, y.gid, a.norm, b.norm HAVING sum(x.x * y.x) / (a.norm * b.norm) >= 0.92),
ahead AS MATERIALIZED (
  SELECT e.id AS earlier, l.id AS later
  FROM (SELECT earlier, later FROM ratios UNION SELECT earlier, later FROM cosines) r
  JOIN free e ON e.gid = r.earlier JOIN free l ON l.gid = r.later WHERE e.id < l.id),
{walk('free', 'ahead')},
leaders AS (
  SELECT gid, id AS place FROM free JOIN winners USING (id)
  UNION ALL SELECT gid, seeded FROM places WHERE seeded IS NOT NULL),
tested AS (SELECT t.position, n.gid FROM staged t JOIN nodes n USING (text) WHERE t.stage = 2),
firsts AS (SELECT position, arg_min(ratio, place) AS similarity FROM (
    SELECT position, place, 1.0::DOUBLE AS ratio FROM tested JOIN leaders USING (gid) WHERE place < position
    UNION ALL
    SELECT position, place, ratio FROM tested t JOIN ratios r ON r.later = t.gid
    JOIN leaders l ON l.gid = r.earlier WHERE place < position) GROUP BY position),
outcome AS MATERIALIZED (
  SELECT t.position, w.id IS NOT NULL AS accepted,
    CASE WHEN stage = 0 THEN 'not_found' WHEN stage = 1 THEN 'completeness' WHEN w.id IS NOT NULL THEN NULL
      WHEN f.similarity IS NOT NULL THEN 'duplicate' WHEN NOT good THEN 'quality' ELSE 'semantic_dup' END AS reason,
    CASE WHEN stage = 2 THEN {WITH_DUPLICATE.replace('similarity', 'f.similarity')} ELSE 0.0 END::DOUBLE AS quality_score
  FROM staged t LEFT JOIN firsts f USING (position) LEFT JOIN winners w ON w.id = t.position)
"""


@query(VALIDATED + "SELECT position, accepted, reason, quality_score FROM outcome")
def validated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, seeds = to_validate(spark, sf_dir)
    return validation.validate_pairs(pairs, "position", 0.4, seeds, md5_encoder).select(
        "position", "accepted", "reason", "quality_score"
    )


@query(VALIDATED + """SELECT position, accepted, reason FROM outcome WHERE position <= coalesce(
  (SELECT position FROM outcome WHERE accepted ORDER BY position LIMIT 1 OFFSET 39), 9223372036854775807)""")
def pairs_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, seeds = to_validate(spark, sf_dir)
    return validation.validate_until(pairs, "position", 40, 0.4, seeds, md5_encoder).select(
        "position", "accepted", "reason"
    )


@query(f"""WITH RECURSIVE {CHECKS[4:]},
held AS (SELECT id AS pos, {sql_collapse('lower(question)')} AS text FROM pairs),
{HELD}, {ratios('nodes')},
firsts AS (SELECT pos, arg_min(ratio, earlier) AS similarity FROM (
    SELECT pos, gid AS earlier, 1.0::DOUBLE AS ratio FROM held_as WHERE gid < pos
    UNION ALL SELECT pos, earlier, ratio FROM held_as JOIN ratios ON later = gid WHERE earlier < pos) GROUP BY pos)
SELECT id, {WITH_DUPLICATE} AS quality_score,
  CASE WHEN length_ok AND relevance_ok AND similarity IS NULL THEN 'approved' ELSE 'pending' END AS validation_status
FROM totals LEFT JOIN firsts ON pos = id""")
def curated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = inputs.pairs(spark, sf_dir).select("id", "question", "answer")
    return validation.store_curated(pairs, "id").select("id", "quality_score", "validation_status")


REASONED = "['not_found','completeness','quality','duplicate','semantic_dup',NULL,NULL][conv_id % 7 + 1]"


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a reason drawn from their number, for the summaries."""
    kinds = [*[F.lit(r) for r in validation.REASONS], F.lit(None), F.lit(None)]
    reason = F.element_at(F.array(*kinds), (F.col("conv_id") % 7).cast("int") + 1)
    return inputs.pairs(spark, sf_dir).select(
        "id", reason.alias("reason"), reason.isNull().alias("accepted")
    )


@query(f"""WITH {PAIRS} SELECT count(*) AS total_validated, count(*) FILTER (r IS NULL) AS total_accepted,
  count(r) AS total_rejected, round(count(*) FILTER (r IS NULL) / greatest(count(*), 1), 6) AS acceptance_rate,
  count(*) FILTER (r = 'not_found') AS not_found, count(*) FILTER (r = 'completeness') AS completeness,
  count(*) FILTER (r = 'quality') AS quality, count(*) FILTER (r = 'duplicate') AS duplicate,
  count(*) FILTER (r = 'semantic_dup') AS semantic_dup
FROM (SELECT {REASONED} AS r FROM pairs)""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_summary(reasoned(spark, sf_dir)).withColumn(
        "acceptance_rate", F.round("acceptance_rate", 6)
    )


@query(f"""WITH {PAIRS} SELECT k.reason, count(p.id) AS count
FROM (SELECT unnest(['not_found','completeness','quality','duplicate','semantic_dup']) AS reason) k
LEFT JOIN (SELECT id, {REASONED} AS reason FROM pairs) p USING (reason) GROUP BY k.reason""")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rejection_counts(reasoned(spark, sf_dir))
