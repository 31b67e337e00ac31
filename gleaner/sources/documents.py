"""Document scans: file listing, extension routing and text extraction."""
from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.functions.text import strip

ALLOWED = ["pdf", "xml", "docx"]  # fixed value
MAX_BYTES = 100 * 1024 * 1024  # fixed value

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_EXTRACTED = StructType([StructField("text", StringType()), StructField("error", StringType())])


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def file_extension(name: Column) -> Column:
    """Lower-case extension without the dot; a leading dot starts a name."""
    return F.lower(F.regexp_extract(name, r"[^/\\]\.([^./\\]*)\z", 1))


def scan_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of a folder as ``(path, modificationTime, length, content)``."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    )


def register_sources(files: DataFrame, project_id: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Source rows of scanned files; refused ones keep a row with the reason.

    Works on ``files(path, length)``: contents are not read.
    """
    name = file_name(F.col("path"))
    kind = file_extension(name)
    error = F.when(~kind.isin(ALLOWED), F.concat(F.lit("type not allowed: "), kind)).when(
        F.col("length") > max_bytes, F.lit("file too large")
    )
    return files.select(
        F.sha2(F.concat_ws(":", F.lit(project_id), "path"), 256).alias("source_id"),
        F.lit(project_id).alias("project_id"),
        F.col("path").alias("filepath"),
        name.alias("filename"),
        kind.alias("file_type"),
        F.col("length").alias("size_bytes"),
        F.when(error.isNull(), "pending").otherwise("rejected").alias("processing_status"),
        error.alias("error_message"),
    )


def _xml_text(blob: bytes | None) -> tuple[str | None, str | None]:
    """Leading text of every element, blank ones dropped, joined by blank lines."""
    try:
        texts = [e.text for e in ET.fromstring(blob or b"").iter() if isinstance(e.tag, str) and e.text]
        return "\n\n".join(t for t in texts if t.strip()), None
    except Exception as problem:  # a broken file is a row with an error
        return None, str(problem) or type(problem).__name__


def _docx_text(blob: bytes | None) -> tuple[str | None, str | None]:
    """Body paragraphs of a Word file; tables, headers and footers are not text."""
    try:
        with zipfile.ZipFile(io.BytesIO(blob or b"")) as archive:
            body = ET.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
        marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
        texts = []
        for paragraph in [] if body is None else body.findall(f"{_WORD}p"):
            runs = [r for r in paragraph.iter(f"{_WORD}r")]
            text = "".join(
                (n.text or "") if n.tag == f"{_WORD}t" else marks.get(n.tag, "")
                for r in runs
                for n in r
            )
            if text.strip():
                texts.append(text)
        return "\n\n".join(texts), None
    except Exception as problem:  # a broken file is a row with an error
        return None, str(problem) or type(problem).__name__


_READERS = {"xml": _xml_text, "docx": _docx_text}


@F.pandas_udf(_EXTRACTED)
def file_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text and error of each file content by its type; both null for other types."""
    for kinds, blobs in batches:
        found = [_READERS[k](b) if k in _READERS else (None, None) for k, b in zip(kinds, blobs)]
        yield pd.DataFrame(found, columns=["text", "error"])


def xml_text(content: Column) -> Column:
    """``(text, error)`` of XML content."""
    return file_text(F.lit("xml"), content.cast("binary"))


def docx_text(content: Column) -> Column:
    """``(text, error)`` of a Word file's content."""
    return file_text(F.lit("docx"), content)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages ``(doc, page_no, text)`` joined in order, blank ones dropped."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    texts = F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: strip(t) != "")
    return pages.groupBy("doc").agg(
        F.array_join(texts, "\n\n").alias("text"), F.count("*").alias("page_count")
    )


def extract_text(files: DataFrame, page_texts: DataFrame | None = None) -> DataFrame:
    """Route ``files(path, content)`` by extension to ``(path, file_type, text, error)``.

    PDF pages come as ``page_texts(doc, page_no, text)``, read by whatever
    page reader the cluster has; files without a reader become error rows.
    """
    kind = file_extension(file_name(F.col("path")))
    read = F.col("file_type").isin(list(_READERS))
    found = (
        files.select("path", kind.alias("file_type"), "content")
        # contents of other types are not sent to Python
        .withColumn("found", file_text("file_type", F.when(read, F.col("content"))))
        .select("path", "file_type", "found.text", "found.error")
    )
    if page_texts is not None:
        whole = assemble_pages(page_texts).select(F.col("doc").alias("path"), F.col("text").alias("pages"))
        found = found.join(whole, "path", "left")
    else:
        found = found.withColumn("pages", F.lit(None).cast("string"))
    is_pdf = F.col("file_type") == "pdf"
    text = F.when(is_pdf, F.col("pages")).otherwise(F.col("text"))
    error = (
        F.when(is_pdf, F.when(F.col("pages").isNull(), F.lit("no page text")))
        .when(~F.col("file_type").isin(ALLOWED), F.concat(F.lit("unsupported file type: ."), "file_type"))
        .otherwise(F.col("error"))
    )
    return found.select("path", "file_type", text.alias("text"), error.alias("error"))
