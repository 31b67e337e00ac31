"""Queries over cleaning, chunking and the source readers."""
from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from gleaner.functions import chunking
from gleaner.functions.text import clean_text
from gleaner.operators import chunks
from gleaner.plans import inputs
from gleaner.plans.registry import (
    PAIRS, SPACE, query, sql_clean, sql_strip, sql_words,
)
from gleaner.session import checkpoint_folder
from gleaner.sources import articles, documents, qa_xml
from gleaner.streaming import ingest

WORD_WINDOWS = f"""
WITH cleaned AS (SELECT *, {sql_clean('text')} AS t FROM documents),
tokens AS (SELECT *, {sql_words('t')} AS w FROM cleaned),
windows AS (SELECT *, unnest(range(0, len(w), 450)) AS s FROM tokens),
kept AS (SELECT *, w[s + 1 : s + 500] AS c FROM windows WHERE len(w[s + 1 : s + 500]) >= 20),
chunk_rows AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index,
  array_to_string(c, ' ') AS content, len(c) AS word_count FROM kept)
"""


@query(f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(WORD_WINDOWS + "SELECT doc_id, chunk_index, content, word_count FROM chunk_rows")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.chunk_documents(inputs.documents(spark, sf_dir))
    return rows.select(F.col("source_id").alias("doc_id"), "chunk_index", "content", "word_count")


@query(WORD_WINDOWS + """SELECT source, count(*) AS chunks, sum(word_count) AS words,
  max(word_count) AS longest FROM chunk_rows GROUP BY source""")
def source_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.chunk_documents(inputs.documents(spark, sf_dir))
    return rows.groupBy(F.col("source_filename").alias("source")).agg(
        F.count("*").alias("chunks"),
        F.sum("word_count").alias("words"),
        F.max("word_count").alias("longest"),
    )


@query(WORD_WINDOWS + "SELECT doc_id, chunk_index, content, word_count FROM chunk_rows")
def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arriving in two batches, the second with all of the first again."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    arriving = inputs.documents(spark, sf_dir).select("source_id", "project_id", "filename", "text")
    early = arriving.filter(F.pmod(F.xxhash64("source_id"), F.lit(2)) == 0)
    for batch in (early, arriving):
        batch.write.mode("append").parquet(f"{folder}/documents")
        stream = spark.readStream.schema(arriving.schema).parquet(f"{folder}/documents")
        ingest.ingest_documents(stream, f"{folder}/index", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/index").select(
        F.col("source_id").alias("doc_id"), "chunk_index", "content", "word_count"
    )


PARAGRAPHS = f"""
WITH RECURSIVE spread AS (
  SELECT doc_id, unnest(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+')) AS p,
    generate_subscripts(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), 1) AS i
  FROM documents),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, {sql_strip('p')} AS p,
    len({sql_words('p')}) AS n FROM spread WHERE {sql_strip('p')} <> ''),
fold AS (
  SELECT doc_id, k, p, n, n AS size, 1 AS part FROM paras WHERE k = 1
  UNION ALL
  SELECT x.doc_id, x.k, x.p, x.n, CASE WHEN f.size + x.n > 120 THEN x.n ELSE f.size + x.n END,
    CASE WHEN f.size + x.n > 120 THEN f.part + 1 ELSE f.part END
  FROM fold f JOIN paras x ON x.doc_id = f.doc_id AND x.k = f.k + 1),
merged AS (
  SELECT doc_id, part, string_agg(p, chr(10) || chr(10) ORDER BY k) AS content, sum(n) AS words
  FROM fold GROUP BY doc_id, part HAVING sum(n) >= 20)
"""


@query(PARAGRAPHS + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1
  AS chunk_index, content FROM merged""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the given documents hold single line breaks only: each becomes a blank line
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return inputs.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(chunking.create_chunks(text, "paragraph", 120)).alias(
            "chunk_index", "content"
        )
    )


SECTIONS = f"""
WITH titled AS (
  SELECT doc_id, replace(text, chr(10), chr(10) || 'Part of ' || source || ': ' || chr(10)) AS text
  FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM titled),
heads AS (
  SELECT *, CASE WHEN i > 1 AND regexp_matches({sql_strip('line')},
    '^(?:[A-Z](?:[A-Z]|{SPACE}){{4,}}|\\p{{Nd}}+\\.[\\p{{Nd}}.]*{SPACE}+(?s:.)+|(?s:.){{5,60}}:{SPACE}*)$')
    THEN 1 ELSE 0 END AS head FROM lines),
numbered AS (
  SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS section_no FROM heads)
SELECT doc_id, section_no, string_agg(line, chr(10) ORDER BY i) AS section
FROM numbered GROUP BY doc_id, section_no
"""


def titled_text() -> Column:
    """Document text with a heading line put before every line but the first."""
    head = F.concat(F.lit("\nPart of "), "filename", F.lit(": \n"))
    return F.replace(F.col("text"), F.lit("\n"), head)


@query(SECTIONS)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select(
        "doc_id",
        F.posexplode(chunking.split_sections(titled_text())).alias("section_no", "section"),
    )


SECTION_CHUNKS = f"""WITH RECURSIVE sections AS ({SECTIONS}),
sized AS (SELECT *, len({sql_words('section')}) AS n, string_split_regex(section, '\\n\\n+') AS split FROM sections),
spread AS (SELECT doc_id, section_no, unnest(split) AS p, generate_subscripts(split, 1) AS i FROM sized WHERE n > 40),
paras AS MATERIALIZED (
  SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i) AS k,
    {sql_strip('p')} AS p, len({sql_words('p')}) AS n FROM spread WHERE {sql_strip('p')} <> ''),
fold AS (
  SELECT doc_id, section_no, k, p, n, n AS size, 1 AS part FROM paras WHERE k = 1
  UNION ALL
  SELECT x.doc_id, x.section_no, x.k, x.p, x.n, CASE WHEN f.size + x.n > 40 THEN x.n ELSE f.size + x.n END,
    CASE WHEN f.size + x.n > 40 THEN f.part + 1 ELSE f.part END
  FROM fold f JOIN paras x ON x.doc_id = f.doc_id AND x.section_no = f.section_no AND x.k = f.k + 1),
pieces AS (
  SELECT doc_id, section_no, part, string_agg(p, chr(10) || chr(10) ORDER BY k) AS content
  FROM fold GROUP BY doc_id, section_no, part HAVING sum(n) >= 20
  UNION ALL
  SELECT doc_id, section_no, 1, {sql_strip('section')} FROM sized WHERE n BETWEEN 20 AND 40)
"""


@query(SECTION_CHUNKS + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part) - 1
  AS chunk_index, content FROM pieces""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select(
        "doc_id",
        F.posexplode(chunking.create_chunks(titled_text(), "section", 40)).alias("chunk_index", "content"),
    )


@query(WORD_WINDOWS + "SELECT doc_id, count(*) AS chunks FROM chunk_rows GROUP BY doc_id")
def unknown_strategy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown strategy name means word windows."""
    rows = inputs.documents(spark, sf_dir).select(
        "doc_id", F.explode(chunking.create_chunks(clean_text(F.col("text")), "sentence"))
    )
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query(f"""
SELECT doc_id, CASE WHEN t <> '' THEN 'completed' ELSE 'failed' END AS processing_status,
  CASE WHEN t <> '' THEN NULL WHEN bad THEN 'unreadable' ELSE 'no text extracted' END AS error_message
FROM (SELECT doc_id, coalesce(toxic = 1, false) AS bad,
        CASE WHEN toxic = 1 THEN '' ELSE {sql_clean('text')} END AS t
      FROM documents LEFT JOIN labels USING (doc_id))""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir)
    toxic = inputs.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False))
    extracted = docs.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("path"),
        F.when(~bad, clean_text(F.col("text"))).alias("text"),
        F.when(bad, "unreadable").alias("error"),
    )
    sources = docs.select("doc_id", F.col("doc_id").alias("filepath"))
    return chunks.processing_status(sources, extracted).select(
        "doc_id", "processing_status", "error_message"
    )


ARTICLE_CHUNKS = f"""
WITH full_rows AS (
  SELECT doc_id, s.place AS place, s.section AS section, s.body AS body FROM (
    SELECT doc_id, unnest([{{'place': 0, 'section': 'Final Results', 'body': lang || ' ' || text}},
                          {{'place': 1, 'section': 'Methods', 'body': text}}]) AS s
    FROM documents WHERE doc_id % 2 = 0 AND {sql_strip('text')} <> '')),
full_tokens AS (SELECT *, {sql_words('body')} AS w FROM full_rows),
full_windows AS (
  SELECT doc_id, place, section, 0 AS s, body AS content FROM full_tokens WHERE len(w) <= 500
  UNION ALL
  SELECT doc_id, place, section, s, array_to_string(w[s + 1 : s + 500], ' ') FROM (
    SELECT *, unnest(range(0, len(w), 450)) AS s FROM full_tokens WHERE len(w) > 500)
  WHERE len(w[s + 1 : s + 500]) >= 50),
plain_tokens AS (
  SELECT doc_id, {sql_words(sql_clean('text'))} AS w FROM documents
  WHERE NOT (doc_id % 2 = 0 AND {sql_strip('text')} <> '')),
plain_windows AS (
  SELECT doc_id, 0 AS place, 'abstract' AS section, s, array_to_string(w[s + 1 : s + 500], ' ') AS content
  FROM (SELECT *, unnest(range(0, len(w), 450)) AS s FROM plain_tokens)
  WHERE len(w[s + 1 : s + 500]) >= 20),
everything AS (SELECT * FROM full_windows UNION ALL SELECT * FROM plain_windows)
SELECT row_number() OVER (ORDER BY doc_id, place, s) - 1 AS chunk_index, section, content FROM everything
"""


@query(ARTICLE_CHUNKS)
def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.chunk_articles(inputs.article_rows(spark, sf_dir), "p0")
    return rows.select("chunk_index", "section", "content")


@query(WORD_WINDOWS + """SELECT source_type, count(*) AS chunks, count(DISTINCT project_id) AS projects
FROM (SELECT 'PDF' AS source_type, 'p0' AS project_id FROM chunk_rows UNION ALL
      SELECT 'PubMed', 'p0' FROM (""" + ARTICLE_CHUNKS + """)) GROUP BY source_type""")
def all_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = chunks.all_chunks(
        chunks.chunk_documents(inputs.documents(spark, sf_dir)),
        chunks.chunk_articles(inputs.article_rows(spark, sf_dir), "p0"),
    )
    return both.groupBy("source_type").agg(
        F.count("*").alias("chunks"), F.countDistinct("project_id").alias("projects")
    )


@query(WORD_WINDOWS + """, names AS (SELECT doc_id, source FROM documents WHERE lang <> 'en')
SELECT coalesce(n.source, 'unknown') AS source_filename, count(*) AS chunks
FROM chunk_rows c LEFT JOIN names n USING (doc_id) GROUP BY ALL""")
def chunk_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.documents(spark, sf_dir)
    rows = chunks.chunk_documents(docs).drop("source_filename")
    named = chunks.with_source_name(rows, docs.filter("lang <> 'en'").select("source_id", "filename"))
    return named.groupBy("source_filename").agg(F.count("*").alias("chunks"))


FILES = """(SELECT url || ['/a.PDF','/b.xml','.docx','/c.txt',''][page_id % 5 + 1] AS path,
  strlen(html) AS length FROM pages)"""


@query(f"""
SELECT path AS filepath, filename, file_type, length AS size_bytes,
  CASE WHEN bad IS NULL THEN 'pending' ELSE 'rejected' END AS processing_status, bad AS error_message
FROM (SELECT *, CASE WHEN file_type NOT IN ('pdf','xml','docx') THEN 'type not allowed: ' || file_type
                     WHEN length > 4000 THEN 'file too large' END AS bad
      FROM (SELECT *, lower(regexp_extract(filename, '[^/]\\.([^./]*)$', 1)) AS file_type
            FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS filename FROM {FILES})))""")
def registered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inputs.table(spark, sf_dir, "pages")
    ending = inputs.picked(F.col("page_id"), "/a.PDF", "/b.xml", ".docx", "/c.txt", "")
    files = pages.select(
        F.concat("url", ending).alias("path"), F.octet_length("html").cast("long").alias("length")
    )
    return documents.register_sources(files, "p0", max_bytes=4000).drop("source_id", "project_id")


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a small XML file: an empty tag, the text, a tail."""
    body = F.concat(
        F.lit("<doc><meta/><lang>"), "lang", F.lit("</lang><text>"),
        inputs.escaped(F.col("text")), F.lit("<b>bold</b>tail</text></doc>"),
    )
    return inputs.documents(spark, sf_dir).select("doc_id", body.alias("content"))


SAFE = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN
    array_to_string(list_filter([lang, replace({SAFE}, chr(13), chr(10)), 'bold'],
      lambda t: {sql_strip('t')} <> ''), chr(10) || chr(10)) END AS text, doc_id % 10 = 3 AS broken FROM documents""")
def xml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth file is cut off: an error row."""
    c = F.col("content")
    content = F.when(F.col("doc_id") % 10 == 3, F.substr(c, F.lit(1), F.length(c) - 6)).otherwise(c)
    found = xml_documents(spark, sf_dir).select("doc_id", documents.xml_text(content).alias("found"))
    return found.select("doc_id", "found.text", F.col("found.error").isNotNull().alias("broken"))


KEYWORDS = ["tion the", "ent", "Ciónos "]


@query(f"""WITH {PAIRS}, found AS (
  SELECT id, {sql_strip('asked')} AS question, {sql_strip("replied")} AS answer,
    'Talk ' || t.conv_id AS title
  FROM turns t JOIN pairs p ON p.id = t.conv_id * 100 + t.turn)
SELECT id, question, answer FROM found WHERE question <> '' AND answer <> '' AND (
  contains(lower(title || ' ' || question || ' ' || answer), 'tion the')
  OR contains(lower(title || ' ' || question || ' ' || answer), 'ent')
  OR contains(lower(title || ' ' || question || ' ' || answer), 'ciónos'))""")
def keyword_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth pair stands outside the wrapping element."""

    def wrap(tag: str) -> Column:
        return F.when(F.col("conv_id") % 5 == 0, F.lit("")).otherwise(F.lit(tag))

    xml = F.concat(
        F.lit("<document><full_title>Talk "), F.col("conv_id").cast("string"),
        F.lit("</full_title>"), wrap("<qa_pairs>"), F.lit("<qa_pair><question>"), inputs.escaped(F.col("asked")),
        F.lit("</question><answer>"), inputs.escaped(F.col("replied")),
        F.lit("</answer></qa_pair>"), wrap("</qa_pairs>"), F.lit("</document>"),
    )
    rows = inputs.turns(spark, sf_dir).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), xml.alias("content")
    )
    return qa_xml.keyword_pairs(qa_xml.parse_qa_documents(rows, "content"), KEYWORDS)


@F.pandas_udf(BinaryType())
def _word_file(texts: pd.Series) -> pd.Series:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def packed(text: str) -> bytes:
        paragraphs = "".join(
            f'<w:p><w:r><w:t xml:space="preserve">{line}</w:t></w:r></w:p>'
            for line in text.split("\n")
        )
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(
                "word/document.xml", f"<w:document {space}><w:body>{paragraphs}</w:body></w:document>"
            )
        return out.getvalue()

    return texts.map(packed)


@query(f"""SELECT id, array_to_string(list_filter(string_split(replied, chr(10)),
  lambda t: {sql_strip('t')} <> ''), chr(10) || chr(10)) AS text, NULL::VARCHAR AS error
FROM (SELECT conv_id * 100 + turn AS id, replied FROM (WITH {PAIRS} SELECT * FROM turns))""")
def word_file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.turns(spark, sf_dir).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        _word_file(inputs.escaped(F.col("replied"))).alias("content"),
    )
    return rows.withColumn("found", documents.docx_text("content")).select(
        "id", "found.text", "found.error"
    )


@query(f"""SELECT conv_id AS doc, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn)
  FILTER ({sql_strip('text')} <> ''), '') AS text, count(*) AS page_count
FROM conversations GROUP BY conv_id""")
def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = inputs.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text"
    )
    return documents.assemble_pages(pages)


@query(f"""SELECT doc_id, ['pdf','xml','docx','txt'][doc_id % 4 + 1] AS file_type,
  CASE doc_id % 4 WHEN 0 THEN CASE WHEN {sql_strip('text')} <> '' THEN text ELSE '' END
    WHEN 1 THEN array_to_string(list_filter([lang, replace({SAFE}, chr(13), chr(10)), 'bold'],
      lambda t: {sql_strip('t')} <> ''), chr(10) || chr(10)) END AS text,
  CASE doc_id % 4 WHEN 2 THEN 'File is not a zip file' WHEN 3 THEN 'unsupported file type: .txt' END AS error
FROM documents""")
def routed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction by extension: pages for PDF, XML, broken Word files, unknown types."""
    docs = inputs.documents(spark, sf_dir)
    ending = inputs.picked(F.col("doc_id"), ".pdf", ".xml", ".docx", ".txt")
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), ending)
    files = xml_documents(spark, sf_dir).select(
        path.alias("path"), F.col("content").cast("binary").alias("content")
    )
    pages = docs.select(path.alias("doc"), F.lit(1).alias("page_no"), "text")
    return documents.extract_text(files, pages).select(
        F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "file_type", "text", "error"
    )


@query(r"""SELECT doc_id::VARCHAR AS pmid, 'About ' || source || ' now' AS title,
  'AIM: ' || trim(body) || ' ' || lang AS abstract, 'Doe Jo;Roe;Poe B;Moe C;Foe D' AS authors,
  'Journal ' || lang AS journal, '2024' AS pub_year, '10.1/' || doc_id AS doi
FROM (SELECT *, """ + sql_strip(f"replace({SAFE}, chr(13), chr(10))") + r""" AS body FROM documents)
WHERE length('AIM: ' || body || ' ' || lang) > 50""")
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    people = "".join(
        f"<Author><LastName>{last}</LastName>{f'<ForeName>{fore}</ForeName>' if fore else ''}</Author>"
        for last, fore in [
            ("Doe", "Jo"), ("Roe", ""), ("Poe", "B"), ("Moe", "C"), ("Foe", "D"), ("Noe", "E")
        ]
    )
    xml = F.concat(
        F.lit("<PubmedArticle><PMID>"), number, F.lit("</PMID><ArticleTitle>About <i>"), "filename",
        F.lit("</i> now</ArticleTitle><Abstract><AbstractText Label='AIM'>"),
        inputs.escaped(F.col("text")), F.lit("</AbstractText><AbstractText>"), "lang",
        F.lit(f"</AbstractText></Abstract><AuthorList>{people}</AuthorList><Journal><Title>Journal "),
        "lang", F.lit(
            "</Title><PubDate><Year>2024</Year></PubDate></Journal>"
            "<ArticleId IdType='pii'>x</ArticleId><ArticleId IdType='doi'>10.1/"
        ), number, F.lit("</ArticleId></PubmedArticle>"),
    )
    rows = inputs.documents(spark, sf_dir).select(xml.alias("content"))
    return articles.parse_articles(rows).withColumn("authors", F.array_join("authors", ";"))


@query(f"""SELECT doc_id, '## Outer' || chr(10) || trim(b || ' inner ' || lang) || chr(10) || chr(10)
  || '## Inner' || chr(10) || 'inner ' || lang AS full_text, 'Outer;Inner' AS names
FROM (SELECT doc_id, lang, {sql_strip(f"replace({SAFE}, chr(13), chr(10))")} AS b FROM documents)""")
def full_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(
        F.lit("<article><body><sec><title>Outer</title><p>"), inputs.escaped(F.col("text")),
        F.lit("</p><sec><title>Inner</title><p>inner <i>"), "lang",
        F.lit("</i></p></sec></sec></body></article>"),
    )
    rows = inputs.documents(spark, sf_dir).select("doc_id", xml.alias("content"))
    return articles.parse_full_text(rows).select(
        "doc_id", "full_text",
        F.array_join(F.transform("sections", lambda s: s["name"]), ";").alias("names"),
    )


@query("""SELECT doc_id::VARCHAR AS pmid FROM documents
WHERE contains(lower(text), 'ciónos') OR contains(lower('Article ' || source || ' ' || lang), 'src7 ')
   OR contains(lower(text), 'thanedble')""")
def article_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.article_rows(spark, sf_dir).withColumn(
        "title", F.concat("title", F.lit(" "))
    )
    return articles.search_articles(rows, ["Ciónos", "  ", "src7 de", "thanedble", "src7 en",
                                           "src7 fr", "src7 es"]).select("pmid")


@query("""WITH merged AS (
  SELECT doc_id AS id, doc_id AS position, 0 AS part FROM labels WHERE quality = 1
  UNION ALL
  SELECT doc_id, n_chars, 1 FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)),
ranked AS (SELECT id, row_number() OVER (ORDER BY part, position, id) - 1 AS place FROM merged)
SELECT id, place FROM ranked WHERE place < 700""")
def merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = inputs.table(spark, sf_dir, "labels").filter("quality = 1").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("position")
    )
    everything = inputs.documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("n_chars").alias("position")
    )
    return articles.merge_id_lists(good, everything, 700)


LOOKUP = """(SELECT d.doc_id AS position, d.doc_id::VARCHAR AS pmid,
  CASE WHEN l.quality = 1 THEN 'PMC' || d.doc_id WHEN l.toxic IS NOT NULL OR d.doc_id % 3 = 0
       THEN 'OLD' || d.doc_id END AS pmcid
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def with_pmcids(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = inputs.table(spark, sf_dir, "labels")
    pmid = F.col("doc_id").cast("string").alias("pmid")
    primary = labels.filter("quality = 1").select(
        pmid, F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid")
    )
    third = inputs.documents(spark, sf_dir).filter("doc_id % 3 = 0").select("doc_id")
    legacy = labels.select("doc_id").unionByName(third).distinct().select(
        pmid, F.concat(F.lit("OLD"), F.col("doc_id").cast("string")).alias("pmcid")
    )
    return articles.attach_pmcids(inputs.article_rows(spark, sf_dir), primary, legacy)


@query(f"SELECT pmid, pmcid FROM {LOOKUP}")
def pmcid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pmcids(spark, sf_dir).select("pmid", "pmcid")


@query(f"""SELECT pmid, pmcid FROM (SELECT *, row_number() OVER (ORDER BY position, pmid) AS place
  FROM {LOOKUP} WHERE pmcid IS NOT NULL) WHERE place <= 250""")
def full_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.full_text_selection(with_pmcids(spark, sf_dir), 250).select("pmid", "pmcid")


def with_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_pmcids(spark, sf_dir).drop("full_text", "sections")
    body = rows.filter("pmcid is not null").select(
        "position", "pmcid", F.concat(F.lit("Body: "), "abstract").alias("full_text"),
        F.array(F.struct(F.lit("Body").alias("name"), F.col("abstract").alias("text"))).alias(
            "sections"
        ),
    )
    return articles.attach_full_text(
        rows, body.filter("position % 4 = 0"), body.filter("position % 2 = 0")
    )


@query(f"""SELECT pmid, CASE WHEN pmcid IS NULL OR position % 2 <> 0 THEN NULL
  WHEN position % 4 = 0 THEN 'pmc' ELSE 'europepmc' END AS full_text_source FROM {LOOKUP}""")
def full_text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_full_text(spark, sf_dir).select("pmid", "full_text_source")


@query(f"""SELECT pmid, CASE WHEN pmcid IS NOT NULL AND position % 2 = 0 THEN 'Body: ' || text ELSE text END
    AS content, 'Article ' || source || ' ' || lang || ' - PMID:' || pmid AS display_name
  FROM {LOOKUP} l JOIN documents d ON d.doc_id = l.position""")
def best_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_full_text(spark, sf_dir).select(
        "pmid",
        articles.best_content(F.col("full_text"), F.col("abstract")).alias("content"),
        articles.display_name(F.col("title"), F.col("pmid")).alias("display_name"),
    )


@query(f"""SELECT 5000 AS total_ids_found, count(*) AS total_fetched,
  count(*) FILTER (pmcid IS NOT NULL AND position % 2 = 0) AS full_text_count,
  count(*) FILTER (NOT (pmcid IS NOT NULL AND position % 2 = 0)) AS abstract_only_count FROM {LOOKUP}""")
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.fetch_summary(with_full_text(spark, sf_dir), 5000)
