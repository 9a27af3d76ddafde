"""Documents into pages: PDF files, Markdown files, tables of text."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import count_tokens
from quire.schemas import PAGES

Extract = Callable[[bytes], list[str]]


def _first_library(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError:
        from PyPDF2 import PdfReader
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def _second_library(data: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as document:
        return [page.get_text() for page in document]


def is_mostly_empty(texts: list[str], threshold: float = 0.8) -> bool:
    """No page, or at least that share of pages with fewer than ten characters."""
    return not texts or sum(len(t.strip()) < 10 for t in texts) / len(texts) >= threshold


def extractors() -> list[Extract]:
    """The PDF readers installed here, the preferred one first."""
    found: list[Extract] = []
    for names, extract in ((("pypdf", "PyPDF2"), _first_library), (("fitz",), _second_library)):
        for name in names:
            try:
                __import__(name)
            except ImportError:
                continue
            found.append(extract)
            break
    return found


def page_texts(data: bytes, readers: list[Extract], prefer_second: bool = False) -> list[str]:
    """A PDF's pages; a result that is mostly empty is tried again with the other reader."""
    if not readers:
        raise ImportError("reading PDF files needs pypdf, PyPDF2 or PyMuPDF")
    ordered = readers[::-1] if prefer_second else readers
    texts = ordered[0](data)
    return ordered[1](data) if is_mostly_empty(texts) and len(ordered) > 1 else texts


def check_source(path: object) -> str:
    """The path of a PDF file, or an error that says what is wrong."""
    if not isinstance(path, str | os.PathLike):
        raise ValueError("the source must be a PDF path or bytes")
    text = os.fspath(path)
    if not text.lower().endswith(".pdf"):
        raise ValueError(f"Expected a .pdf file: {text}")
    if not os.path.exists(text):
        raise ValueError(f"file not found: {text}")
    return text


def document_name(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def pdf_pages(files: DataFrame, max_pages: int | None = None, readers: Callable[[], list[Extract]] = extractors, prefer_second: bool = False) -> DataFrame:
    """``(doc_id, page_number, text, token_count, doc_name, error)`` of ``files(doc_id, doc_name, content)``.

    Files that do not start like a PDF, cannot be read or have more than ``max_pages`` give one row
    with ``error`` and no page. Unpaired surrogates are replaced.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "page_number", "text", "doc_name", "error"]
        for batch in batches:
            for doc, name, content in zip(batch["doc_id"], batch["doc_name"], batch["content"]):
                data = bytes(content)
                try:
                    if b"%PDF" not in data[:10]:
                        raise ValueError("not a PDF file")
                    texts = page_texts(data, readers(), prefer_second)
                    if max_pages and len(texts) > max_pages:
                        raise ValueError(f"more than {max_pages} pages")
                    rows = [(doc, n, t.encode("utf-8", "replace").decode(), name, None) for n, t in enumerate(texts, 1)]
                except Exception as error:
                    rows = [(doc, None, None, name, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=columns).astype({"page_number": "Int32"})

    pages = files.select("doc_id", "doc_name", "content").mapInPandas(run, "doc_id long, page_number int, text string, doc_name string, error string")
    return pages.withColumn("token_count", count_tokens(F.col("text")))


def read_pdf(spark: SparkSession, folder: str | list[str], max_pages: int | None = None, readers: Callable[[], list[Extract]] = extractors, prefer_second: bool = False) -> DataFrame:
    """``pdf_pages`` of all PDF files in a folder, or of some paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    named = files.select(F.xxhash64("path").alias("doc_id"), document_name(F.col("path")).alias("doc_name"), "content")
    return pdf_pages(named, max_pages, readers, prefer_second)


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, doc_name, content)`` of all Markdown files in a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.[mM][dD]")
    path = F.input_file_name()
    return files.select(F.xxhash64(path).alias("doc_id"), document_name(path).alias("doc_name"), F.col("value").alias("content"))


def from_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", lines_per_page: int = 4) -> DataFrame:
    """Pages of a fixed number of lines each; null texts have none. Expressions only, no shuffle."""
    lines = F.split(F.col(text), "\n")
    parts = F.ceil(F.size(lines) / lines_per_page).cast("int")
    page = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.array_join(F.slice(lines, i * lines_per_page + 1, lines_per_page), "\n"))
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.posexplode(page).alias("n", "text"))
    return rows.select("doc_id", (F.col("n") + 1).alias("page_number"), "text", count_tokens(F.col("text")).alias("token_count"))


def document_texts(pages: DataFrame) -> DataFrame:
    """``(doc_id, document_text, page_count, total_tokens)``: a document's pages joined by blank lines, null pages empty."""
    row = F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))
    grouped = pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(row)).alias("p"), F.count(F.lit(1)).alias("page_count"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens")
    )
    return grouped.select("doc_id", F.array_join("p.text", "\n\n").alias("document_text"), "page_count", "total_tokens")


def list_documents(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """``(doc_id, doc_name, path)`` of the files of a folder, by path only: no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select(F.xxhash64("path").alias("doc_id"), document_name(F.col("path")).alias("doc_name"), "path")


def empty_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PAGES)


def render_images(documents: DataFrame, folder: str, zoom: float = 2.0) -> DataFrame:
    """``(doc_id, page_number, path)``: pages of ``documents(doc_id, content)`` drawn into a shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                with fitz.open(stream=bytes(content), filetype="pdf") as document:
                    for n, page in enumerate(document, 1):
                        path = os.path.join(folder, f"{doc}_page_{n}.jpg")
                        page.get_pixmap(matrix=fitz.Matrix(zoom, zoom)).save(path)
                        rows.append((doc, n, path))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "path"])

    return documents.select("doc_id", "content").mapInPandas(run, "doc_id long, page_number int, path string")
