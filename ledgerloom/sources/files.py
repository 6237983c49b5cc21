"""File sources: uploads as binary files, word documents, optional PDF adapters, ledgers and notes in JSON."""

from __future__ import annotations

import importlib
import io
import itertools
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators.tables import upload_error
from ..schemas import LINE, TABLE_ROW

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, length, content`` of PDF and word files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.md5(F.col("path").cast("binary")).alias("doc_id"), "path", "length", "content")


def read_docx(content: bytes) -> tuple[list[str], list[list[str]]]:
    """(texts of the non-empty paragraphs outside tables, rows of stripped cells) of a word document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    paragraphs = [text(p) for p in body.findall(f"{_WORD}p")]
    rows = [[text(c).strip() for c in r.findall(f"{_WORD}tc")] for t in body.findall(f"{_WORD}tbl") for r in t.findall(f"{_WORD}tr")]
    return [p for p in paragraphs if p.strip()], rows


def _docx_rows(files: DataFrame, made: Callable[[list[str], list[list[str]]], list[tuple]], schema: str) -> DataFrame:
    """``made`` of each word document's paragraphs and rows, after its doc_id; broken files have none."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    out += [(doc_id, *row) for row in made(*read_docx(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(out, columns=names)

    return files.select("doc_id", "content").mapInPandas(run, schema)


def docx_lines(files: DataFrame) -> DataFrame:
    """Layout lines of word documents: one page, a line for each paragraph. Broken files have none."""
    return _docx_rows(files, lambda paragraphs, _: [("layout", 0, i, p) for i, p in enumerate(paragraphs)], LINE)


def docx_tables(files: DataFrame) -> DataFrame:
    """Table rows of word documents."""
    return _docx_rows(files, lambda _, rows: list(enumerate(rows)), TABLE_ROW)


def extracted(files: DataFrame, extract: Callable[[bytes], Iterable[tuple[int, str]]], source: str, max_pages: int | None = None) -> DataFrame:
    """Lines that an injected extractor (PDF layout, text recognition) finds as (page from 0, text), pages in order: give it the gated
    documents only, as Spark pushes no filter through it. From page ``max_pages`` on it is asked no further. A document that it
    fails on has no lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    found = list(itertools.takewhile(lambda x: max_pages is None or x[0] < max_pages, extract(content)))
                except Exception:  # noqa: BLE001  any failure of a foreign library means no text
                    continue
                out += [(doc_id, source, page, i, text.strip()) for i, (page, text) in enumerate(found) if text and text.strip()]
            yield pd.DataFrame(out, columns=["doc_id", "source", "page_no", "pos", "text"])

    return files.select("doc_id", "content").mapInPandas(run, LINE)


def extracted_tables(files: DataFrame, extract: Callable[[bytes], Iterable[list[list[str | None] | None]]]) -> DataFrame:
    """Table rows that an injected extractor finds, a table (or none) a page; cells may be null, rows too, which go. A document
    that it fails on has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    rows = [row for table in extract(content) for row in table or [] if row is not None]
                except Exception:  # noqa: BLE001  any failure of a foreign library means no table
                    continue
                out += [(doc_id, i, [None if c is None else str(c) for c in row]) for i, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=["doc_id", "row_no", "cells"])

    return files.select("doc_id", "content").mapInPandas(run, TABLE_ROW)


def page_counts(files: DataFrame, count: Callable[[bytes], tuple[int, bool]]) -> DataFrame:
    """``files`` with ``pages`` and ``encrypted``, as an injected reader finds them; null for word documents and files it fails on."""

    @F.pandas_udf("pages int, encrypted boolean")
    def counted(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for path, content in zip(paths, contents, strict=True):
            try:
                out.append(count(content) if path.lower().endswith(".pdf") else (None, None))
            except Exception:  # noqa: BLE001  any failure of a foreign library means unknown
                out.append((None, None))
        return pd.DataFrame({"pages": pd.array([x[0] for x in out], "Int32"), "encrypted": pd.array([x[1] for x in out], "boolean")})

    return files.withColumn("_counted", counted("path", "content")).select(*files.columns, "_counted.pages", "_counted.encrypted")


def checked_uploads(files: DataFrame, count: Callable[[bytes], tuple[int, bool]], settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(files that pass all checks, ``doc_id, path, error_code`` of the others). Name and size are checked before a file is opened."""
    first = files.withColumn("error_code", upload_error(F.col("path"), F.col("length"), F.lit(False), F.lit(0), settings=settings))
    opened = page_counts(first.where("error_code is null").drop("error_code"), count)
    opened = opened.withColumn("error_code", upload_error(F.col("path"), F.col("length"), F.col("encrypted"), F.col("pages"), settings=settings))
    rejected = first.where("error_code is not null").select("doc_id", "path", "error_code")
    return opened.where("error_code is null").drop("error_code"), rejected.unionByName(opened.where("error_code is not null").select("doc_id", "path", "error_code"))


def pdf_counter() -> Callable[[bytes], tuple[int, bool]]:
    """(pages, encrypted) of a PDF where a library is installed."""
    fitz = _optional("fitz")

    def count(content: bytes) -> tuple[int, bool]:
        with fitz.open(stream=content, filetype="pdf") as doc:
            return len(doc), bool(doc.needs_pass)

    return count


def pdf_table_extractor() -> Callable[[bytes], Iterable[list[list[str | None] | None]]]:
    """A PDF table extractor (the largest table of each page) where a library is installed."""
    plumber = _optional("pdfplumber")

    def extract(content: bytes) -> Iterator[list[list[str | None] | None]]:
        with plumber.open(io.BytesIO(content)) as pdf:
            for page in pdf.pages:
                yield page.extract_table()

    return extract


def text_recogniser(dpi: int = 300) -> Callable[[bytes], Iterable[tuple[int, str]]]:
    """A text recogniser of PDF pages, one page image at a time, where the libraries are installed."""
    images, recognise = _optional("pdf2image"), _optional("pytesseract")

    def extract(content: bytes) -> Iterator[tuple[int, str]]:
        for n in range(images.pdfinfo_from_bytes(content)["Pages"]):
            for image in images.convert_from_bytes(content, dpi=dpi, first_page=n + 1, last_page=n + 1):
                for line in recognise.image_to_string(cleaned_image(np.asarray(image))).splitlines():
                    yield n, line

    return extract


def cleaned_image(pixels: np.ndarray, window: int = 31, offset: int = 2) -> np.ndarray:
    """A page image made ready for recognition: grey, smoothed, then black where a pixel is darker than its surroundings.

    ``pixels``: rows x columns (x red, green, blue), 0 to 255. A pixel's threshold is the Gaussian mean of the window around it less ``offset``.
    """
    grey = pixels.astype(np.float64)
    if grey.ndim == 3:
        grey = grey[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    grey = _blurred(grey, 3, 0.8)
    mean = _blurred(grey, window, 0.3 * ((window - 1) * 0.5 - 1) + 0.8)
    return np.where(grey > mean - offset, 255, 0).astype(np.uint8)


def _blurred(grey: np.ndarray, window: int, sigma: float) -> np.ndarray:
    half = window // 2
    weights = np.exp(-((np.arange(window) - half) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    for axis in (0, 1):
        wide = np.pad(grey, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        grey = sum(w * np.take(wide, np.arange(k, k + grey.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return grey


def _optional(module: str):
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise RuntimeError(f"this reader needs the optional package that provides the module {module}") from e


def pdf_extractor() -> Callable[[bytes], list[tuple[int, str]]]:
    """A PDF layout extractor where a library is installed."""
    fitz = _optional("fitz")

    def extract(content: bytes) -> list[tuple[int, str]]:
        with fitz.open(stream=content, filetype="pdf") as doc:
            return [(n, line) for n, page in enumerate(doc) for line in page.get_text().splitlines()]

    return extract


def token_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``period, key, tokens`` of a JSON ledger {"daily": {..}, "monthly": {..}, "hourly": {..}}; missing, empty and corrupt files have no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "period string, key string, tokens bigint")
    kind = "daily map<string,bigint>, monthly map<string,bigint>, hourly map<string,bigint>, _corrupt_record string"
    raw = spark.read.schema(kind).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    names = {"daily": "day", "monthly": "month", "hourly": "hour"}
    parts = [raw.select(F.lit(p).alias("period"), F.explode(c).alias("key", "tokens")) for c, p in names.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def prompt_notes(spark: SparkSession, path: str) -> DataFrame:
    """``suggestion, reason`` of a JSON list of notes; a missing file has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "suggestion string, reason string")
    return spark.read.schema("suggestion string, reason string").option("multiLine", True).json(path)
