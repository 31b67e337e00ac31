"""Queries over reports, listings, splits, exports and table changes."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import changes, listing, reports, splits
from gleaner.operators.validation import evaluate_pairs
from gleaner.plans import inputs
from gleaner.plans.registry import PAIRS, query
from gleaner.session import checkpoint_folder, checkpointed
from gleaner.sinks import exports, tables
from gleaner.streaming import progress

P = f"WITH {PAIRS} "


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the shared store."""
    return f"{checkpoint_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"


def pairs_and(extra: str) -> str:
    return f"WITH {PAIRS}, {extra} "


# -- statistics --------------------------------------------------------------

STATS = """stats AS (SELECT count(*) AS total, count(*) FILTER (validation_status = 'approved') AS approved,
  count(*) FILTER (validation_status = 'pending') AS pending,
  count(*) FILTER (validation_status = 'rejected') AS rejected,
  nullif(round(avg(quality_score), 4), 0) AS avg_quality_score FROM pairs)"""


@query(pairs_and(STATS) + "SELECT * FROM stats")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pair_stats(inputs.pairs(spark, sf_dir))


@query(pairs_and(STATS) + """SELECT total, round(approved / total * 100, 6) AS approved_rate,
  round(rejected / total * 100, 6) AS rejected_rate FROM stats""")
def approval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = reports.approval_rates(reports.pair_stats(inputs.pairs(spark, sf_dir)))
    return rates.select(
        "total", *[F.round(c, 6).alias(c) for c in ("approved_rate", "rejected_rate")]
    )


@query(P + "SELECT validation_status AS status, count(*) AS count FROM pairs GROUP BY 1")
def status_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_slices(reports.pair_stats(inputs.pairs(spark, sf_dir)))


@query(P + "SELECT source_type, count(*) AS count FROM pairs GROUP BY 1")
def pairs_by_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_source_type(inputs.pairs(spark, sf_dir))


@query(P + """SELECT regexp_replace(upper(source_type), '_', ' + ') AS name, count(*) AS count
FROM pairs GROUP BY 1""")
def source_type_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports.count_by_source_type(inputs.pairs(spark, sf_dir))
    return counts.select(reports.chart_name(F.col("source_type")).alias("name"), "count")


@query(P + "SELECT model_used, count(*) AS count FROM pairs WHERE model_used IS NOT NULL GROUP BY 1")
def pairs_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_by_model(inputs.pairs(spark, sf_dir))


TOP = "SELECT {cols} FROM (SELECT text AS source_document, count(*) AS count FROM documents GROUP BY 1) " \
      "ORDER BY count DESC, source_document LIMIT {n}"


def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts in the part of long source names."""
    return inputs.documents(spark, sf_dir).select(F.col("text").alias("source_document"))


@query(TOP.format(cols="source_document, count", n=50))
def top_source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_source_documents(text_sources(spark, sf_dir))


@query(TOP.format(cols="CASE WHEN length(source_document) > 40 THEN left(source_document, 37) || '…' "
                       "ELSE source_document END AS name, source_document AS full_name, count", n=10))
def top_documents_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_documents_chart(text_sources(spark, sf_dir))


FILES = """named AS (SELECT *, CASE WHEN conv_id % 10 = 3 THEN '' ELSE source_document END AS document,
  CASE WHEN conv_id % 12 = 0 THEN 'upload' || (conv_id % 5) END AS original_file FROM pairs),
files AS (SELECT coalesce(nullif(document, ''), nullif(original_file, ''), '(' || source_type || ')') AS filename,
  arg_max(source_type, (created_at, id)) AS source_type, count(*) AS pair_count,
  round(avg(quality_score), 4) AS avg_quality,
  count(*) FILTER (validation_status = 'approved') AS approved,
  count(*) FILTER (validation_status = 'rejected') AS rejected,
  count(*) FILTER (validation_status NOT IN ('approved', 'rejected')) AS pending
  FROM named GROUP BY 1)"""


@query(pairs_and(FILES) + "SELECT *, round(approved / (approved + rejected + pending) * 100, 6) AS "
       "approval_percent FROM files")
def pairs_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    rows = inputs.pairs(spark, sf_dir).withColumns(
        {
            "source_document": F.when(c % 10 == 3, "").otherwise(F.col("source_document")),
            "original_file": F.when(
                c % 12 == 0, F.concat(F.lit("upload"), (c % 5).cast("string"))
            ),
        }
    )
    return reports.with_approval_percent(reports.by_file(rows)).withColumn(
        "approval_percent", F.round("approval_percent", 6)
    )


@query(P + """SELECT printf('%.1f-%.1f', bucket / 10.0, (bucket + 1) / 10.0) AS range, count(*) AS count
FROM (SELECT least(floor(quality_score * 10), 9) AS bucket FROM pairs WHERE quality_score IS NOT NULL)
GROUP BY bucket""")
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_histogram(inputs.pairs(spark, sf_dir))


@query(P + "SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count FROM pairs GROUP BY 1")
def daily_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_timeline(inputs.pairs(spark, sf_dir))


@query("""SELECT c.c_custkey AS id, c.c_name AS name, coalesce(n, 0) AS total_qa_pairs,
  coalesce(a, 0) AS total_approved, q AS avg_quality_score, coalesce(s, 0) AS total_sources
FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS a,
    nullif(round(avg((o_orderkey % 101) / 101.0::DOUBLE), 4), 0) AS q FROM orders GROUP BY 1) o
  ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT user_id, count(*) AS s FROM events GROUP BY 1) e ON e.user_id = c.c_custkey""")
def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = inputs.table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"))
    rows = reports.project_rollup(
        inputs.projects(spark, sf_dir), inputs.order_pairs(spark, sf_dir), sources
    )
    return rows.drop("status", "updated_at")


@query(P + """SELECT 'total' AS kind, '' AS name, count(*) AS count FROM pairs
UNION ALL SELECT 'run', '', count(*) FILTER (generation_job_id = 'job2') FROM pairs
UNION ALL SELECT 'source', source_type, count(*) FROM pairs GROUP BY 2
UNION ALL SELECT 'status', validation_status, count(*) FROM pairs GROUP BY 2""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_summary(inputs.pairs(spark, sf_dir), "job2")


# -- listings ----------------------------------------------------------------


@query(P + """SELECT id FROM pairs WHERE project_id = 'p1' AND source_type <> '' AND
  validation_status = 'pending' AND quality_score >= 0.2 AND quality_score <= 0.9
  AND (question ILIKE '%e%tion%' OR answer ILIKE '%e%tion%')""")
def filtered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filter_pairs(
        inputs.pairs(spark, sf_dir), search="e%tion", min_quality_score=0.2,
        max_quality_score=0.9, project_id="p1", validation_status="pending", model_used=None,
    ).select("id")


@query(P + "SELECT id FROM pairs WHERE question ILIKE '%TH_ A%' OR answer ILIKE '%TH_ A%'")
def searched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filter_pairs(inputs.pairs(spark, sf_dir), search="TH_ A").select("id")


@query(P + """SELECT id FROM pairs WHERE project_id = 'p2' AND generation_job_id = 'job1'
  AND validation_status IN ('approved', 'pending') AND quality_score >= 0.1""")
def export_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filter_for_export(
        inputs.pairs(spark, sf_dir), "p2", "job1", ["approved", "pending"], 0.1
    ).select("id")


@query(P + "SELECT id, question FROM pairs ORDER BY created_at DESC, id LIMIT 25 OFFSET 25")
def newest_pairs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.newest_pairs(inputs.pairs(spark, sf_dir), number=2).select("id", "question")


@query(P + "SELECT count(*) AS total, (count(*) + 24) // 25 AS total_pages FROM pairs")
def pair_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page_counts(inputs.pairs(spark, sf_dir), 25)


PROJECTS = """(SELECT c_custkey AS id, c_name AS name, ['draft','active','archived'][c_custkey % 3 + 1] AS status,
  c_custkey * 13 AS updated FROM customer)"""


@query(f"SELECT id, name FROM {PROJECTS} WHERE status = 'active' ORDER BY updated DESC, id LIMIT 25 OFFSET 50")
def newest_projects_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.newest_projects(inputs.projects(spark, sf_dir), "active", number=3)
    return rows.select("id", "name")


@query(f"""SELECT 'active' AS part, id FROM {PROJECTS} WHERE status IN ('draft', 'active')
UNION ALL SELECT 'archived', id FROM {PROJECTS} WHERE status = 'archived'""")
def projects_by_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.projects(spark, sf_dir)
    live = listing.active_projects(rows).select(F.lit("active").alias("part"), "id")
    return live.unionByName(
        listing.archived_projects(rows).select(F.lit("archived").alias("part"), "id")
    )


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.operators.ranking import with_global_rank

    rows = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")
    )
    ranked = with_global_rank(listing.newest_first(rows), F.desc("created_at"), F.col("id"), name="place")
    return ranked.select("id", (F.col("place") + 1).alias("place"))


@query("SELECT doc_id AS id, ['xml','pdf','docx'][doc_id % 3 + 1] AS file_type FROM documents "
       "WHERE doc_id % 3 IN (1, 2)")
def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        inputs.picked(F.col("doc_id"), "xml", "pdf", "docx").alias("file_type"),
    )
    return listing.of_type(rows, "pdf", "docx")


@query(P + """SELECT id FROM pairs WHERE project_id = 'p1' AND id IN (SELECT doc_id * 100 FROM labels)""")
def pairs_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = inputs.table(spark, sf_dir, "labels").select((F.col("doc_id") * 100).alias("id"))
    return listing.by_ids(inputs.pairs(spark, sf_dir), ids, "p1").select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.operators.review import pending_for_review

    rows = inputs.documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
    done = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return pending_for_review(rows, done)


# -- splits and exports ------------------------------------------------------

SPLIT = """placed AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS place,
  count(*) OVER () AS n FROM pairs),
parts AS (SELECT *, CASE WHEN place < floor(n * 0.8::DOUBLE) THEN 'train'
  WHEN place < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed)"""


@query(pairs_and(SPLIT) + "SELECT id, split FROM parts")
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_exact(inputs.pairs(spark, sf_dir)).select("id", "split")


@query(P + "SELECT count(*) AS rows, count(*) AS distinct_ids, 0::BIGINT AS without_split FROM pairs")
def hash_split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.split_by_hash(inputs.pairs(spark, sf_dir))
    return split.agg(
        F.count("*").alias("rows"),
        F.countDistinct("id").alias("distinct_ids"),
        F.count_if(~F.col("split").isin(*splits.SPLITS)).alias("without_split"),
    )


def export_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with retrieval metadata on the rag ones."""
    rag = F.col("source_type") == "rag_ollama"
    c = F.col("conv_id")
    metadata = F.struct(
        rag.alias("rag"),
        F.when(rag, F.concat(F.lit("term "), c.cast("string"))).alias("query_term"),
        F.when(rag, F.array(c.cast("string"), (c + 1).cast("string"))).alias("citation_chunk_ids"),
        F.when(rag, F.array(F.lit(0.5), c / F.lit(1000.0))).alias("retrieval_scores"),
    )
    return inputs.pairs(spark, sf_dir).withColumn("metadata", metadata)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.export_rows(export_source(spark, sf_dir))


RAG = """rags AS (SELECT *, source_type = 'rag_ollama' AS rag, CASE WHEN source_type = 'rag_ollama'
    THEN 'term ' || conv_id ELSE '' END AS term,
  CASE WHEN source_type = 'rag_ollama' THEN conv_id || ';' || (conv_id + 1) ELSE '' END AS ids,
  CASE WHEN source_type = 'rag_ollama' THEN '0.5000;' || printf('%.4f', conv_id / 1000.0) ELSE '' END AS scores
  FROM pairs)"""


@query(pairs_and(RAG) + """SELECT question, answer, source_type, quality_score, validation_status,
  CASE WHEN rag THEN 'True' ELSE 'False' END AS rag, term AS query_term, ids AS citation_chunk_ids,
  scores AS retrieval_scores FROM rags""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.csv_rows(exported(spark, sf_dir))


@query(P + "SELECT 'question: ' || question || ' answer: ' || answer AS value FROM pairs")
def training_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.training_lines(exported(spark, sf_dir))


BASE_JSON = """'question', question, 'answer', answer, 'source_type', source_type,
    'quality_score', quality_score, 'validation_status', validation_status"""


@query(pairs_and(RAG) + f"""SELECT CASE WHEN rag THEN
    regexp_replace(json_object({BASE_JSON}, 'rag', true, 'query_term', term,
      'citation_chunk_ids', string_split(ids, ';'))::VARCHAR, '.$', '')
      || ',"retrieval_scores":[0.5,' || CASE WHEN conv_id % 1000 = 0 THEN (conv_id / 1000.0)::VARCHAR
         ELSE rtrim(printf('%.3f', conv_id / 1000.0), '0') END || ']}}'
  ELSE json_object({BASE_JSON})::VARCHAR END AS value FROM rags""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.json_records(exported(spark, sf_dir))


EVIDENCE_JSON = """, 'rag', true, 'query_term', term, 'citation_chunk_ids', string_split(ids, ';')"""


@query(pairs_and(RAG) + f"""SELECT CASE WHEN rag THEN
    regexp_replace(json_object('question', question, 'answer', answer{EVIDENCE_JSON})::VARCHAR, '.$', '')
      || ',"retrieval_scores":[0.5,' || CASE WHEN conv_id % 1000 = 0 THEN (conv_id / 1000.0)::VARCHAR
         ELSE rtrim(printf('%.3f', conv_id / 1000.0), '0') END || ']}}'
  ELSE json_object('question', question, 'answer', answer)::VARCHAR END AS value FROM rags""")
def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.jsonl_records(exported(spark, sf_dir))


@query(P + "SELECT json_object('instruction', question, 'input', '', 'output', answer)::VARCHAR AS value FROM pairs")
def instruction_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.instruction_records(exported(spark, sf_dir))


@query(P + f"""SELECT json_object('messages', [json_object('role', 'system', 'content', '{exports.ASSISTANT}'),
  json_object('role', 'user', 'content', question),
  json_object('role', 'assistant', 'content', answer)])::VARCHAR AS value FROM pairs""")
def chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.chat_records(exported(spark, sf_dir))


@query(pairs_and(RAG) + """SELECT question, answer, source_type, quality_score, validation_status, rag,
  term AS query_term, CASE WHEN rag THEN '["' || replace(ids, ';', '","') || '"]' ELSE '' END AS citation_chunk_ids
  FROM rags""")
def parquet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.parquet_rows(exported(spark, sf_dir), lists_as_json=True).drop("retrieval_scores")


@query(pairs_and(SPLIT) + """SELECT split, json_object('messages', [
  json_object('role', 'system', 'content', 'You are a knowledgeable medical assistant.'),
  json_object('role', 'user', 'content', question),
  json_object('role', 'assistant', 'content', answer)])::VARCHAR AS value FROM parts""")
def written_split_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs written as one project's chat files, per split, and read back."""
    rows = export_source(spark, sf_dir).withColumn("project_id", F.lit("all"))
    folder = f"{fresh_folder(spark)}/export"
    out = exports.export_project(rows, folder, "openai", "all", "a b/c", "1", train=0.8, val=0.1)
    read = [spark.read.text(path).select(F.lit(name).alias("split"), "value") for name, path in out.items()]
    return reduce(DataFrame.unionByName, read)


@query(P + """SELECT id, question, answer, validation_status, 3::BIGINT AS checks,
  ['format', 'length', 'relevance'] AS check_types FROM pairs""")
def rewritten_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and checks written in two batches, each of them twice, and read back."""
    folder = fresh_folder(spark)
    rows = checkpointed(evaluate_pairs(inputs.pairs(spark, sf_dir)))  # eight tables are written from it
    odd = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    for batch, part in [("a", rows.filter(~odd)), ("b", rows.filter(odd))] * 2:
        tables.write_pairs(folder, batch, part)
    checks = tables.read_batches(spark, folder, "checks").groupBy(F.col("qa_pair_id").alias("id")).agg(
        F.count("*").alias("checks"), F.array_sort(F.collect_list("check_type")).alias("check_types")
    )
    return tables.read_batches(spark, folder, "pairs").join(checks, "id").select(
        "id", "question", "answer", "validation_status", "checks", "check_types"
    )


# -- changes -----------------------------------------------------------------


@query(P + """SELECT id, CASE WHEN l.quality = 1 THEN 'New ' || question ELSE question END AS question,
  coalesce(CASE WHEN l.toxic = 1 THEN 'rejected' END, validation_status) AS validation_status,
  coalesce(l.quality = 1, false) AS human_edited
FROM pairs LEFT JOIN labels l ON l.doc_id = pairs.conv_id""")
def edited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    edits = rows.join(
        inputs.table(spark, sf_dir, "labels"), rows["conv_id"] == F.col("doc_id")
    ).select(
        "id",
        F.when(F.col("quality") == 1, F.concat(F.lit("New "), "question")).alias("question"),
        F.when(F.col("toxic") == 1, "rejected").alias("validation_status"),
    )
    return changes.edit_pairs(rows, edits).select(
        "id", "question", "validation_status", "human_edited"
    )


LABELLED = "SELECT p.id FROM pairs p JOIN labels l ON l.doc_id = p.conv_id"


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    labels = inputs.table(spark, sf_dir, "labels")
    return rows.join(labels, rows["conv_id"] == labels["doc_id"]).select("id")


@query(P + f"""SELECT id, CASE WHEN id IN ({LABELLED}) THEN 'approved' ELSE validation_status END
  AS validation_status FROM pairs""")
def bulk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.set_status(
        inputs.pairs(spark, sf_dir), labelled_ids(spark, sf_dir), "approved"
    )
    return rows.select("id", "validation_status")


@query(P + f"SELECT id FROM pairs WHERE id NOT IN ({LABELLED})")
def pairs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.delete_rows(inputs.pairs(spark, sf_dir), labelled_ids(spark, sf_dir))
    return rows.select("id")


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'),
dead AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM gone))
SELECT 'projects' AS name, count(*) AS rows FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'qa_pairs', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'quality_checks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM dead)
UNION ALL SELECT 'sources', count(*) FROM events WHERE user_id NOT IN (SELECT * FROM gone)""")
def projects_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = inputs.table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    left = changes.delete_projects(
        {
            "projects": inputs.projects(spark, sf_dir),
            "qa_pairs": inputs.order_pairs(spark, sf_dir),
            "quality_checks": inputs.table(spark, sf_dir, "lineitem").select(
                F.col("l_orderkey").alias("qa_pair_id")
            ),
            "sources": inputs.table(spark, sf_dir, "events").select(
                F.col("user_id").alias("project_id")
            ),
        },
        gone,
    )
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, df in left.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    fact = F.struct(
        (c % 11).cast("double").alias("factual_accuracy"),
        F.when(c % 3 == 0, F.concat(F.lit("Better: "), "question")).alias("suggested_answer"),
    )
    empty = "struct<old_answer:string,source:string,fact_check_score:double>"
    return inputs.pairs(spark, sf_dir).withColumns(
        {"fact_check": fact, "suggestion_applied": F.lit(None).cast(empty)}
    )


ACCEPTED = f"""accepted AS (SELECT id, conv_id, answer AS old, id IN ({LABELLED}) AND conv_id % 3 = 0 AS hit,
  CASE WHEN id IN ({LABELLED}) AND conv_id % 3 = 0 THEN 'Better: ' || question ELSE answer END AS answer FROM pairs)"""


@query(pairs_and(ACCEPTED) + """SELECT id, answer, hit AS human_edited, CASE WHEN hit THEN old END AS old_answer,
  CASE WHEN hit THEN (conv_id % 11)::DOUBLE END AS fact_check_score FROM accepted""")
def accepted_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.accept_suggestions(with_facts(spark, sf_dir), labelled_ids(spark, sf_dir))
    return rows.select(
        "id", "answer", "human_edited", "suggestion_applied.old_answer",
        "suggestion_applied.fact_check_score",
    )


@query(pairs_and(ACCEPTED) + """SELECT id, CASE WHEN hit AND conv_id % 2 = 0 THEN old ELSE answer END AS answer,
  hit AND conv_id % 2 <> 0 AS still_applied FROM accepted""")
def reverted_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.accept_suggestions(with_facts(spark, sf_dir), labelled_ids(spark, sf_dir))
    even = rows.filter("conv_id % 2 = 0").select("id")
    return changes.revert_suggestions(rows, even).select(
        "id", "answer", F.col("suggestion_applied").isNotNull().alias("still_applied")
    )


# -- event states ------------------------------------------------------------


@query("""WITH e AS (SELECT user_id AS job_id, ts, value AS percentage, json_extract_string(props, '$.k') AS message,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status
  FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY status = 'in_progress',
    CASE WHEN status <> 'in_progress' THEN ts END, ts DESC) AS rn FROM e)
SELECT job_id, percentage, message, status FROM r WHERE rn = 1""")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.progress_events(inputs.table(spark, sf_dir, "events"))
    return progress.latest_progress(events).drop("ts")


@query("""SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
FROM events GROUP BY user_id""")
def latest_event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    return reports.latest_state(events, "user_id", "ts", "event_type", "value").drop("ts")


@query("""SELECT CASE WHEN event_type = 'view' THEN 'accepted' ELSE event_type END AS outcome, count(*) AS count
FROM events GROUP BY 1""")
def running_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = inputs.table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("reason")
    )
    return progress.running_counts(outcomes)
