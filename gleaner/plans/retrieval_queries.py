"""Queries over embeddings, retrieval and prompts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.operators import prompts, retrieval
from gleaner.plans import inputs
from gleaner.plans.encoding import md5_encoder, md5_entries
from gleaner.plans.registry import PAIRS, query, sql_words

TOP_K = 5

HITS = """topics AS (
  SELECT label::BIGINT AS position, 'topic' || label AS query, arg_min(embedding, vec_id) AS vec
  FROM embeddings GROUP BY label),
hits AS (
  SELECT query, e.vec_id AS chunk_id, 'src' || e.label AS source_filename,
    list_inner_product(t.vec::DOUBLE[], e.embedding::DOUBLE[]) AS score
  FROM topics t JOIN embeddings e
    ON list_inner_product(t.vec::DOUBLE[], e.embedding::DOUBLE[]) >= 0.25),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS pool_rank FROM hits)
"""


def diverse_sql(name: str, k: str) -> str:
    return f"""{name}_turns AS (
  SELECT *, row_number() OVER (PARTITION BY query, source_filename ORDER BY pool_rank) AS turn,
    min(pool_rank) OVER (PARTITION BY query, source_filename) AS lead_rank
  FROM ranked WHERE pool_rank <= 10 * {k}),
{name}_picks AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY turn, lead_rank) AS pick
  FROM {name}_turns WHERE turn <= 3),
{name} AS (
  SELECT query, row_number() OVER (PARTITION BY query ORDER BY pool_rank) AS rank, chunk_id,
    source_filename, score FROM {name}_picks WHERE pick <= {k})
"""


DIVERSE = f"WITH {HITS}, {diverse_sql('chosen', '5')}"
ROUNDED = "query, rank, chunk_id, source_filename, round(score, 6) AS score"


def hits(spark: SparkSession, sf_dir: str, pool: int) -> DataFrame:
    return retrieval.scored_hits(
        inputs.topics(spark, sf_dir), inputs.vector_chunks(spark, sf_dir), pool
    )


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {HITS} SELECT query, chunk_id, source_filename, round(score, 6) AS score FROM hits")
def cosine_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.all_hits(inputs.topics(spark, sf_dir), inputs.vector_chunks(spark, sf_dir)))


@query(f"WITH {HITS} SELECT query, pool_rank AS rank, chunk_id, source_filename, round(score, 6) AS score "
       "FROM ranked WHERE pool_rank <= 5")
def plain_top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.plain_top_k(hits(spark, sf_dir, 2 * TOP_K), TOP_K))


@query(DIVERSE + f"SELECT {ROUNDED} FROM chosen")
def diverse_top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.diverse_top_k(hits(spark, sf_dir, 10 * TOP_K), TOP_K))


@query(DIVERSE + """SELECT query, rank, chunk_id, c.source_filename, round(score, 6) AS score,
  coalesce(d.text, '') AS content, (SELECT count(*) FROM embeddings) AS total_indexed
FROM chosen c LEFT JOIN documents d ON d.doc_id = c.chunk_id""")
def topic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.retrieve(
        inputs.topics(spark, sf_dir), inputs.vector_chunks(spark, sf_dir), TOP_K
    )
    return rounded(rows).select(
        "query", "rank", "chunk_id", "source_filename", "score", "content", "total_indexed"
    )


@query(DIVERSE + """SELECT query, string_agg(chunk_id || ':' || source_filename || ':' || (chunk_id % 40)
  || ':' || printf('%.4f', round(score, 4)) || ':' || left(coalesce(text, ''), 200), '|' ORDER BY rank) AS citations,
  string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS ids
FROM chosen c LEFT JOIN documents d ON d.doc_id = c.chunk_id GROUP BY query""")
def topic_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = inputs.vector_chunks(spark, sf_dir)
    rows = retrieval.evidence_lists(
        retrieval.retrieve(inputs.topics(spark, sf_dir), chunks, TOP_K)
    )
    shown = F.transform(
        "citations",
        lambda c: F.concat_ws(
            ":", c["chunk_id"], c["source_filename"], c["chunk_index"],
            F.format_string("%.4f", c["score"]), c["content_preview"],
        ),
    )
    return rows.select(
        "query", F.array_join(shown, "|").alias("citations"),
        F.array_join("citation_chunk_ids", ",").alias("ids"),
    )


@query()
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every document by the stand-in encoder, with their length."""
    rows = inputs.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return retrieval.embed_chunks(rows).select(
        "doc_id", F.size("vec").alias("dim"), F.round(norm, 3).alias("norm")
    )


# entries as thousandths of the largest; 0.3 keeps ratios of counts off the steps of floor
@query(f"""WITH texts AS (SELECT doc_id AS gid, text FROM documents),
entries AS {md5_entries('texts', sql_words('text'))},
parts AS (SELECT gid, string_agg(place || ':' || (sign(x) * floor(abs(x) / top * 1000 + 0.3))::BIGINT, ',' ORDER BY place) AS entries
  FROM (SELECT *, max(abs(x)) OVER (PARTITION BY gid) AS top FROM entries) GROUP BY gid)
SELECT doc_id, coalesce(entries, '') AS entries FROM documents LEFT JOIN parts ON gid = doc_id""")
def embedded_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors themselves: every entry that is not zero, by the largest of its document."""
    rows = inputs.documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"))
    placed = F.transform("vec", lambda x, i: F.struct(i.alias("place"), x.cast("double").alias("x")))
    top = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    # bound once: a column of its own would be put into the lambda and found again for every entry
    shown = let(
        top,
        lambda t: F.transform(
            F.filter(placed, lambda e: e["x"] != 0),
            lambda e: F.concat_ws(":", e["place"], (F.sign(e["x"]) * F.floor(F.abs(e["x"]) / t * 1000 + 0.3)).cast("long")),
        ),
    )
    vectors = retrieval.embed_chunks(rows, md5_encoder)
    return vectors.select("doc_id", F.array_join(shown, ",").alias("entries"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def chunks_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")
    )
    indexed = inputs.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return retrieval.append_embeddings(indexed, rows).select("chunk_id")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 5 <> 3")
def project_vectors_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.drop_project_embeddings(inputs.vector_chunks(spark, sf_dir), "p3")
    return rows.select("chunk_id")


@query("""SELECT source AS filename, string_agg('--- Medical Source (' || source || ') ---' || chr(10) || text,
  chr(10) || chr(10) ORDER BY doc_id) AS block FROM documents GROUP BY source""")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a file as one evidence block."""
    docs = inputs.documents(spark, sf_dir)
    rows = docs.groupBy("filename").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "doc_id", F.col("filename").alias("source_filename"),
                    F.col("text").alias("content"),
                )
            )
        ).alias("chunks")
    )
    return rows.select("filename", prompts.evidence_block(F.col("chunks")).alias("block"))


KINDS = ["factual", "reasoning", "comparison", "application", "riddle"]
LEVELS = ["beginner", "intermediate", "advanced", "expert"]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(_sql_text(v) for v in values) + "]"


def template_sql(templates: dict[str, str], kinds: list[str], levels: list[str], at: str,
                 text: str, domain: str) -> str:
    by_kind = [templates.get(k, templates["factual"]) for k in kinds]
    by_level = [prompts.DIFFICULTIES.get(d, prompts.DIFFICULTIES["intermediate"]) for d in levels]
    return (
        f"replace(replace(replace({_sql_list(by_kind)}[({at}) % {len(kinds)} + 1], '{{domain}}', {domain}), "
        f"'{{difficulty}}', {_sql_list(by_level)}[({at}) % {len(levels)} + 1]), '{{text}}', {text})"
    )


@query("SELECT doc_id, md5(" + template_sql(
    prompts.PLAIN_TEMPLATES, KINDS, LEVELS, "doc_id", "text", "lang") + ") AS plain, md5("
    + template_sql(prompts.EVIDENCE_TEMPLATES, KINDS, LEVELS, "doc_id", "text", "lang")
    + ") AS evidence FROM documents")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both template families over every document, unknown kinds and levels included."""
    at = F.col("doc_id")
    kind, level = prompts.cycled(KINDS, at), prompts.cycled(LEVELS, at)

    def filled(evidence: bool):
        return F.md5(
            prompts.fill_template(kind, F.col("text"), F.col("lang"), level, evidence)
        )

    return inputs.documents(spark, sf_dir).select(
        "doc_id", filled(False).alias("plain"), filled(True).alias("evidence")
    )


@query(f"""WITH {PAIRS}, recent AS (SELECT id, question FROM pairs ORDER BY id DESC LIMIT 15)
SELECT project_id, {_sql_text(prompts.AVOID_HEADING)} || (SELECT string_agg('  - ' || question, chr(10) ORDER BY id)
  FROM recent) AS avoid FROM pairs GROUP BY project_id""")
def avoid_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    suffix = prompts.avoid_suffix(prompts.recent_questions(rows, "id"))
    return rows.select("project_id", F.lit(suffix).alias("avoid")).distinct()


PLAN_TYPES, PLAN_LEVELS, PLAN_TARGET = ["factual", "reasoning", "comparison"], ["beginner", "advanced"], 57
FILLED = template_sql(
    prompts.EVIDENCE_TEMPLATES, PLAN_TYPES, PLAN_LEVELS, "prompt_index", "block", "'cardiology'"
)


@query(f"""WITH {HITS}, {diverse_sql('k0', '5')}, {diverse_sql('k1', '6')}, {diverse_sql('k2', '7')},
picked AS (SELECT 0 AS variant, * FROM k0 UNION ALL SELECT 1, * FROM k1 UNION ALL SELECT 2, * FROM k2),
sized AS (SELECT *, count(*) OVER (PARTITION BY query, variant) AS n
  FROM picked p LEFT JOIN documents d ON d.doc_id = p.chunk_id),
per AS (SELECT greatest(1, {PLAN_TARGET} // greatest(count(*), 1)) AS per_term FROM topics),
found AS (SELECT query, row_number() OVER (ORDER BY position) - 1 AS place
  FROM topics WHERE query IN (SELECT query FROM hits)),
plan AS (SELECT query, turn, place * per_term + turn AS prompt_index FROM (
  SELECT query, place, per_term, unnest(range(0, per_term)) AS turn FROM found, per)),
blocks AS (
  SELECT l.prompt_index, l.query AS query_term,
    string_agg('--- Medical Source (' || s.source_filename || ') ---' || chr(10) || coalesce(s.text, ''), chr(10) || chr(10)
      ORDER BY (s.rank - 1 - l.turn % s.n + s.n) % s.n) AS block,
    arg_min(s.chunk_id, (s.rank - 1 - l.turn % s.n + s.n) % s.n) AS primary_chunk_id,
    string_agg(s.chunk_id::VARCHAR, ',' ORDER BY s.rank) AS cited
  FROM plan l JOIN sized s ON s.query = l.query AND s.variant = l.turn % 3
  WHERE l.prompt_index < {PLAN_TARGET} GROUP BY l.prompt_index, l.query)
SELECT prompt_index, query_term, primary_chunk_id, cited,
  ['factual','reasoning','comparison'][prompt_index % 3 + 1] AS question_type,
  ['beginner','advanced'][prompt_index % 2 + 1] AS difficulty, md5({FILLED}) AS prompt FROM blocks""")
def evidence_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = prompts.rag_prompts(
        inputs.topics(spark, sf_dir),
        inputs.vector_chunks(spark, sf_dir),
        "cardiology", PLAN_TYPES, PLAN_LEVELS, PLAN_TARGET,
    )
    return plan.select(
        "prompt_index", "query_term", "primary_chunk_id",
        F.array_join("citation_chunk_ids", ",").alias("cited"),
        "question_type", "difficulty", F.md5("prompt").alias("prompt"),
    )


SAMPLE_TARGET, SAMPLE_LIMITS = 150, {"de": 20}


@query(f"""WITH drawn AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS draw
  FROM documents),
limited AS (SELECT * FROM drawn WHERE NOT (lang = 'de' AND draw >= 20)),
share AS (SELECT {SAMPLE_TARGET} // count(DISTINCT lang) AS share FROM limited),
taken AS (SELECT doc_id FROM limited, share WHERE draw < share),
spare AS (SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || doc_id), doc_id) - 1 AS place
  FROM limited, share WHERE draw >= share),
chosen AS (SELECT doc_id FROM taken UNION ALL
  SELECT doc_id FROM spare WHERE place < {SAMPLE_TARGET} - (SELECT count(*) FROM taken)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('44:' || doc_id), doc_id) - 1 AS prompt_index FROM chosen)
SELECT prompt_index, doc_id AS chunk_id, ['factual','reasoning'][prompt_index % 2 + 1] AS question_type,
  md5({template_sql(prompts.PLAIN_TEMPLATES, ['factual', 'reasoning'], ['advanced'], 'prompt_index', 'text', "'x'")})
    AS prompt
FROM placed JOIN documents USING (doc_id)""")
def sampled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("source_type"),
        F.col("text").alias("content"), F.col("filename").alias("source_filename"),
    )
    plan = prompts.random_prompts(
        rows, "x", ["factual", "reasoning"], ["advanced"], SAMPLE_TARGET, limits=SAMPLE_LIMITS
    )
    return plan.select("prompt_index", "chunk_id", "question_type", F.md5("prompt").alias("prompt"))
