"""The registered queries of this subpackage and their SQL.

Each applies an operator to its whole table; the SQL is DuckDB's, where SQL
can express the result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import collocations, decontamination, fingerprints, hard_negatives, html_text, jaccard_join, language_id, line_dedup, minhash_join, mixing, passages, token_ids, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def hash_part(of, parts: int):
    """Remainder of the CRC-32 of an id's text; a null id belongs to no part."""
    return F.crc32(of.cast("string")) % parts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# list of words in SQL, lower-casing A-Z only
SQL_LOW = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = f"regexp_extract_all({SQL_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS.format(c='text')} AS w FROM documents),
i AS (SELECT item_id, {SQL_WORDS.format(c='text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + 9], ' '))) AS g
       FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, doc_id, k, unnest(range(1, len(w) - k + 2)) AS p,
         unnest(list_transform(range(1, len(w) - k + 2), lambda q: array_to_string(w[q:q + k - 1], ' '))) AS g
       FROM d, ks WHERE len(w) >= k),
hits AS (SELECT r, p, dw.k AS k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
marked AS (SELECT r, count(DISTINCT q) AS n_hit
           FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""


@query(OP8_SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.overlap_digest(found)


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = F.coalesce(hash_part(F.col("id"), 3) != 1, F.lit(True))
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), usable)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(hash_part(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query()
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.tokenized(table(spark, sf_dir, "documents"), tokenizer_path())


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({SQL_LOW.format(c='text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.x, r.c FROM l JOIN r ON l.y = r.doc_id)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


@query(OP10_SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = F.coalesce(hash_part(F.col("doc_id"), 4) != 2, F.lit(True))
    return language_id.identified(docs, training).select(
        "doc_id",
        F.coalesce(hash_part(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("best").alias("lang_pred"),
        "score",
        "rejected",
    )


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query()
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query()
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH l AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS raw FROM documents),
e AS (SELECT r, source, unnest(range(1, len(raw) + 1)) AS p, unnest(raw) AS line FROM l),
b AS (SELECT r, source, p, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM e),
s AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5),
k AS (SELECT r, count(*) FILTER (WHERE bare <> '') AS n_lines, count(s.bare) AS n_removed,
        string_agg(line, chr(10) ORDER BY p) FILTER (WHERE s.bare IS NULL) AS kept
      FROM b LEFT JOIN s USING (bare) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS text_sha256
FROM l LEFT JOIN k USING (r)
"""


@query(OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


@query()
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.ar, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.ar, positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""


@query(OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    noised = F.when(v % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", noised)
    return hard_negatives.mine_hard_negatives(rows, v % 100 == 0)


OP13_SQL = OP10_SQL.replace(">= 75 *", ">= 85 *").replace("m.c AS component_id", "m.c AS component_id, m.c = d.doc_id AS kept")


@query(OP13_SQL)
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_copies(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
    regexp_split_to_array({SQL_LOW.format(c='text')}, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT r, lang, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda q: array_to_string(w[q:q + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, cut, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(s[:2], ' ') AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(s[2:], ' '), a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, CAST(encode(phrase) AS BLOB)) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, CAST(encode(phrase) AS BLOB)) <= 2000
"""


@query(OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))
