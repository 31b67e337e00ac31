import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators.chunks import chunk_documents, processing_status
from gleaner.operators.splits import split_exact
from gleaner.operators.validation import validate_pairs
from gleaner.sinks import exports, tables
from gleaner.sources import articles, documents, qa_xml
from gleaner.streaming import ingest, progress

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.xml").write_text("<d><t>Title</t><b>body<i> inline</i> tail</b><e> </e></d>")
    with zipfile.ZipFile(tmp_path / "b.DOCX", "w") as z:
        z.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/>'
            "<w:p><w:r><w:t>Two</w:t><w:tab/><w:t>cells</w:t></w:r></w:p></w:body></w:document>",
        )
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.txt").write_text("plain")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    return tmp_path


def test_files_are_registered_routed_and_marked(spark, folder):
    files = documents.scan_files(spark, str(folder))
    sources = documents.register_sources(files, "p")
    status = {r["filename"]: r["processing_status"] for r in sources.collect()}
    assert status == {"a.xml": "pending", "b.DOCX": "pending", "c.docx": "pending", "d.txt": "rejected", "e.pdf": "pending"}
    pages = files.filter("path like '%e.pdf'").select(
        F.col("path").alias("doc"), F.explode(F.array(F.lit(2), F.lit(1), F.lit(3))).alias("page_no")
    ).withColumn("text", F.when(F.col("page_no") == 3, " ").otherwise(F.concat(F.lit("page "), "page_no")))
    found = documents.extract_text(files, pages).withColumn("name", documents.file_name(F.col("path")))
    got = {r["name"]: (r["text"], r["error"]) for r in found.collect()}
    assert got["a.xml"] == ("Title\n\nbody\n\n inline", None)
    assert got["b.DOCX"] == ("One\n\nTwo\tcells", None)
    assert got["c.docx"][0] is None and got["c.docx"][1]
    assert got["d.txt"][1].startswith("unsupported")
    assert got["e.pdf"] == ("page 1\n\npage 2", None)
    marked = {r["filename"]: r["processing_status"] for r in processing_status(sources, found).collect()}
    assert marked["a.xml"] == "completed" and marked["c.docx"] == "failed"


def test_qa_xml_files(spark, tmp_path):
    pair = "<qa_pair><question>{}</question><answer>{}</answer></qa_pair>"
    (tmp_path / "q.xml").write_text(
        "<all><document><full_title>Asthma</full_title><qa_pairs>"
        + pair.format("What?", "This.") + pair.format("", "x") + "</qa_pairs></document>"
        "<document><full_title>Other</full_title><qa_pairs>" + pair.format("Why?", "That.")
        + "</qa_pairs></document></all>"
    )
    docs = qa_xml.read_qa_documents(spark, str(tmp_path))
    got = qa_xml.keyword_pairs(docs, ["ASTHMA", " "]).collect()
    assert [(r["question"], r["source_file"]) for r in got] == [("What?", "q.xml")]
    assert qa_xml.keyword_pairs(docs, [" "]).count() == 0


def test_article_dump_and_full_text(spark, tmp_path):
    art = (
        "<PubmedArticle><PMID>{0}</PMID><ArticleTitle>On <i>{0}</i></ArticleTitle><AbstractText>"
        + "word " * 20 + "</AbstractText></PubmedArticle>"
    )
    (tmp_path / "dump.xml").write_text("<Set>\n" + "\n".join(art.format(i) for i in range(5)) + "\n</Set>")
    rows = articles.parse_articles(articles.read_article_elements(spark, str(tmp_path / "dump.xml")))
    assert sorted((r["pmid"], r["title"]) for r in rows.collect()) == [(str(i), f"On {i}") for i in range(5)]
    xml = (
        "<a><body><sec><title>T</title><p>one</p><sec><title>T</title><p>two</p></sec></sec>"
        "<sec><p>three</p></sec></body></a>"
    )
    df = spark.createDataFrame([(1, xml), (2, "<a><body><p>x</p><p>y</p></body></a>"), (3, "broken")], "k int, content string")
    got = {r["k"]: r for r in articles.parse_full_text(df).collect()}
    assert [tuple(s) for s in got[1]["sections"]] == [("T", "two"), ("Untitled Section", "three")]
    assert got[1]["full_text"].startswith("## T\none two\n\n## T\ntwo")
    assert got[2]["full_text"] == "x\n\ny" and got[3]["full_text"] is None


@pytest.fixture
def stored(spark):
    rows = [
        (i, "p", "j", f"Q {i}, \"x\"?", f"A {i}\nline", "rag_x" if i % 2 else "pdf_x", i / 20, "approved")
        for i in range(20)
    ]
    df = spark.createDataFrame(
        rows,
        "id long, project_id string, generation_job_id string, question string, answer string, "
        "source_type string, quality_score double, validation_status string",
    )
    rag = F.col("id") % 2 == 1
    return df.withColumn(
        "metadata",
        F.struct(
            rag.alias("rag"), F.lit("t").alias("query_term"),
            F.array(F.lit("c1"), F.lit("c2")).alias("citation_chunk_ids"),
            F.array(F.lit(0.5), F.lit(0.25)).alias("retrieval_scores"),
        ),
    )


def test_exports_of_every_format(spark, stored, tmp_path):
    out = {
        fmt: exports.export_project(stored, str(tmp_path), fmt, "p", "a b/c", f"1_{fmt}", min_quality_score=0.1)
        for fmt in exports.FORMATS
    }
    csv = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(out["csv"]["all"])
    assert csv.count() == 18 and csv.columns == exports.EXPORT_COLUMNS
    assert csv.filter("question = 'Q 3, \"x\"?'").first()["retrieval_scores"] == "0.5000;0.2500"
    lines = [json.loads(r["value"]) for r in spark.read.text(out["json"]["all"]).collect()]
    assert {("rag" in x) for x in lines} == {True, False}
    chat = json.loads(spark.read.text(out["openai"]["all"]).first()["value"])
    assert [m["role"] for m in chat["messages"]] == ["system", "user", "assistant"]
    flat = json.loads(spark.read.text(out["alpaca"]["all"]).first()["value"])
    assert set(flat) == {"instruction", "input", "output"}
    assert spark.read.parquet(out["parquet"]["all"]).count() == 18
    with pytest.raises(ValueError):
        exports.write_export(exports.export_rows(stored), "xls", str(tmp_path))
    with pytest.raises(ValueError):
        exports.export_project(stored, str(tmp_path), "csv", "nobody", "d", "2")


def test_split_export_is_disjoint_and_complete(spark, stored, tmp_path):
    split = split_exact(stored)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 16, "val": 2, "test": 2}
    assert split.select("id").distinct().count() == 20
    out = exports.export_project(stored, str(tmp_path), "jsonl", "p", "d", "3", train=0.5, val=0.5)
    assert set(out) == {"train", "val"}
    texts = [r["value"] for p in out.values() for r in spark.read.text(p).collect()]
    assert len(texts) == len(set(texts)) == 20


def test_tables_are_appended(spark, tmp_path):
    docs = spark.createDataFrame([("s", "p", "f", "word " * 40)], "source_id string, project_id string, filename string, text string")
    path = str(tmp_path / "chunks")
    tables.append_chunks(chunk_documents(docs), path)
    tables.append_chunks(chunk_documents(docs), path)
    assert spark.read.parquet(path).filter("project_id = 'p'").count() == 2
    pairs = spark.createDataFrame([(1, "What is the cause of asthma in adults?", "It is caused by many things, mostly allergens and smoke.")], "id long, question string, answer string")
    tables.append_pairs(validate_pairs(pairs, "id"), str(tmp_path / "pairs"), str(tmp_path / "checks"))
    kinds = {r["check_type"] for r in spark.read.parquet(str(tmp_path / "checks")).collect()}
    assert kinds == {"length", "format", "relevance", "duplicate", "completeness"}


def test_batches_are_replaced_together(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        tables.read_batches(spark, folder, "pairs")

    def rows(*ids):
        return spark.createDataFrame([(i,) for i in ids], "id long")

    def stored(name):
        return sorted(r["id"] for r in tables.read_batches(spark, folder, name).collect())

    tables.write_batch(folder, "a", {"pairs": rows(1, 2), "checks": rows(1, 1, 2)})
    tables.write_batch(folder, "b", {"pairs": rows(), "checks": rows()})
    tables.write_batch(folder, "b", {"pairs": rows(3), "checks": rows(3, 3)})
    assert stored("pairs") == [1, 2, 3] and stored("checks") == [1, 1, 2, 3, 3]
    # one table is written, the other fails: the batch stays as it was
    broken = rows(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.write_batch(folder, "a", {"pairs": rows(9), "checks": broken})
    assert stored("pairs") == [1, 2, 3]
    tables.write_batch(folder, "a", {"pairs": rows(2, 4), "checks": rows(4)})
    assert stored("pairs") == [2, 3, 4] and stored("checks") == [3, 3, 4]


def test_progress_stream_keeps_the_terminal_state(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [("a", 1, 10.0, "m", "in_progress"), ("a", 3, 0.0, "m", "failed"), ("b", 1, 5.0, "m", "in_progress")]
    later = [("a", 4, 50.0, "late", "in_progress"), ("b", 2, 7.0, "m2", "in_progress"), ("b", 1, 6.0, "old", "in_progress")]
    schema = "job_id string, ts long, percentage double, message string, status string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    query = progress.start_memory_query(progress.latest_progress(spark.readStream.schema(schema).parquet(path)), "states", "complete")
    try:
        query.processAllAvailable()
        spark.createDataFrame(later, schema).write.mode("append").parquet(path)
        query.processAllAvailable()
        got = {r["job_id"]: (r["percentage"], r["status"]) for r in spark.table("states").collect()}
    finally:
        query.stop()
    assert got == {"a": (0.0, "failed"), "b": (7.0, "in_progress")}


def test_document_stream_adds_each_chunk_once(spark, tmp_path):
    src, index = str(tmp_path / "docs"), str(tmp_path / "index")
    schema = "source_id string, project_id string, filename string, text string"
    one = [("s1", "p", "f1", " ".join(f"w{i}" for i in range(60)))]
    for batch in (one, one + [("s2", "p", "f2", " ".join(f"v{i}" for i in range(60)))]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        ingest.ingest_documents(spark.readStream.schema(schema).parquet(src), index, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(index)
    assert sorted(r["source_id"] for r in got.collect()) == ["s1", "s2"]
    assert got.select(F.size("vec")).first()[0] == 384
    keys = spark.read.parquet(index + "_keys")
    assert keys.select("chunk_id").distinct().count() == keys.count() == 2
    assert sorted(r["source_id"] for r in got.filter("batch = 1").collect()) == ["s2"]


def test_equal_hashes_of_different_chunks_are_both_kept(spark):
    new = spark.createDataFrame([(7, "x", 0), (7, "y", 0), (8, "z", 1)], "finger long, chunk_id string, bucket int")
    known = spark.createDataFrame([(7, "x", 0), (7, "w", 0), (8, "q", 2)], "finger long, chunk_id string, bucket int")
    assert sorted(r["chunk_id"] for r in ingest._not_indexed(new, known).collect()) == ["y", "z"]
    assert ingest._not_indexed(new, known.limit(0)).count() == 3
    assert ingest._not_indexed(new.limit(0), known).count() == 0


def test_validation_stream_knows_earlier_batches(spark, tmp_path):
    src, out = str(tmp_path / "pairs"), str(tmp_path / "out")
    schema = "pos long, question string, answer string"
    answer = "It is caused by many things, mostly allergens and smoke."
    batches = [
        [(0, "What is the cause of asthma in adults?", answer)],
        [(1, "What is the cause of asthma in adult?", answer), (2, "Which drug lowers blood pressure fastest?", answer)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.validate_stream(spark.readStream.schema(schema).parquet(src), "pos", out, str(tmp_path / "ck")).awaitTermination()
    got = {r["pos"]: r["reason"] for r in spark.read.parquet(out).collect()}
    assert got == {0: None, 1: "duplicate", 2: None}
    counts = progress.running_counts(spark.read.parquet(out))
    assert {r["outcome"]: r["count"] for r in counts.collect()} == {"accepted": 2, "duplicate": 1}


def test_articles_are_parsed_a_few_at_a_time():
    xml = "<PubmedArticle><PMID>1</PMID></PubmedArticle>"
    for record in (articles._article_record, articles._full_text_record):
        parts = list(record.func(iter([pa.array([xml] * 200), pa.array([], pa.string())])))
        assert sum(map(len, parts)) == 200 and max(map(len, parts)) <= articles.PARSED


def test_articles_without_an_id_are_dealt_to_all_tasks(spark):
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("pmid"), F.when(F.col("id") < 10, F.concat(F.lit("P"), "id")).alias("pmcid")
    )
    full = rows.filter("pmcid IS NOT NULL").select("pmcid", F.concat(F.lit("t"), "pmcid").alias("full_text"), F.array(
        F.struct(F.lit("n").alias("name"), F.lit("t").alias("text"))).alias("sections"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = articles.attach_full_text(rows, full, full.limit(0)).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
        found = {r["pmid"] for r in out.filter("full_text = concat('t', pmcid)").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and max(sizes) < 500 and found == {str(i) for i in range(10)}
