"""Table rows and the decisions about sources: usability, text recognition gates, payload guard, upload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.amounts import NUMERIC_CELL
from ..functions.metadata import routes_to_parser
from ..functions.text import join_cells

# Fixed values.
EXTENSIONS = (".pdf", ".docx")
MIMES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")


def rightmost_numeric(cells: Column) -> Column:
    """Index (from 0) of the last cell with a number in it; null if none has one."""
    flags = F.transform(cells, lambda c: F.coalesce(c, F.lit("")).rlike(NUMERIC_CELL))
    return F.nullif(F.size(cells) - F.array_position(F.reverse(flags), True), F.size(cells)).cast("int")


def table_usability(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """``usable``: at least three rows, and the commonest place of the last number in half of the rows with numbers, two at least.

    Counted by (document, place) first, so that the second aggregation has a row for each column of a table.
    """
    by_place = rows.select(on, rightmost_numeric(F.col("cells")).alias("place")).groupBy(on, "place").agg(F.count(F.lit(1)).alias("n"))
    there = F.when(F.col("place").isNotNull(), F.col("n"))
    stats = by_place.groupBy(on).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(there), F.lit(0)).alias("n_numeric"), F.coalesce(F.max(there), F.lit(0)).alias("mode_count"))
    enough = F.col("mode_count") >= F.greatest(F.lit(2), F.floor(F.col("n_numeric") * 0.5))
    return stats.withColumn("usable", (F.col("n_numeric") > 0) & enough & (F.col("n_rows") >= 3))


def needs_ocr(has_layout: Column, has_table: Column, usable: Column, forced: Column | None = None) -> Column:
    """Without any text, or with a table that is not usable, or where it is ``forced``."""
    needed = (~has_layout & ~has_table) | (has_table & ~usable)
    return needed if forced is None else needed | F.coalesce(forced, F.lit(False))


def forced_ocr(flag: Column) -> Column:
    """Whether a request's flag asks for text recognition in any case: 1, true or yes."""
    return F.coalesce(F.lower(flag.cast("string")).isin("1", "true", "yes"), F.lit(False))


def needs_ocr_streamed(is_docx: Column, usable: Column) -> Column:
    """The stream's own policy: unless it is a word document or the table is usable."""
    return ~(is_docx | usable)


def over_payload(chars: Column, may_truncate: Column, settings: Settings = DEFAULTS) -> Column:
    return (chars > settings.max_payload_chars) & ~may_truncate


def row_texts(rows: DataFrame) -> DataFrame:
    """The four ways in which rows become text."""
    c = F.col("cells")
    return rows.withColumns({
        "piped": join_cells(c, " | ", True),
        "piped_filled": join_cells(c, " | ", False),
        "spaced": join_cells(c, " ", True),
        "spaced_filled": join_cells(c, " ", False),
    })


def head_and_tail(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """Rows that a shortened table keeps: of more than 30 the first 15 and the last 10, else the first 10; ``part`` tells which."""
    from pyspark.sql import Window

    w = Window.partitionBy(on)
    n = F.count(F.lit(1)).over(w)
    nth = F.row_number().over(w.orderBy("row_no"))
    part = F.when(nth <= F.when(n > 30, 15).otherwise(10), F.lit("head")).when((n > 30) & (nth > n - 10), F.lit("tail"))
    return rows.withColumn("part", part).where("part is not null")


def route_by_bank(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of the deterministic parser, the others)."""
    to_parser = routes_to_parser(F.col("bank_name"))
    return metadata.where(to_parser), metadata.where(~to_parser)


def upload_error(filename: Column, size: Column, encrypted: Column, pages: Column, mime: Column | None = None, settings: Settings = DEFAULTS) -> Column:
    """The status of the first check that fails, or null: extension, media type, size, least size, encryption, pages."""
    name = F.lower(filename)
    known = F.lit(False)
    for e in EXTENSIONS:
        known = known | name.endswith(e)
    pdf = name.endswith(".pdf")
    mime = F.lit(None).cast("string") if mime is None else mime
    return (
        F.when(~known, 400)
        .when(mime.isNotNull() & ~mime.isin(*MIMES), 400)
        .when(size > settings.max_upload_mb * 1024 * 1024, 413)
        .when(size < settings.min_upload_bytes, 400)
        .when(pdf & F.coalesce(encrypted, F.lit(False)), 400)
        .when(pdf & (F.coalesce(pages, F.lit(0)) > settings.max_pages), 413)
    )


def retry_documents(documents: DataFrame, transactions: DataFrame, on: str = "doc_id") -> DataFrame:
    """Documents without transactions: the second pass, whose result replaces nothing else."""
    return documents.join(transactions.select(on).distinct(), on, "left_anti")


def keep_retry(first: DataFrame, retry: DataFrame, on: str = "doc_id") -> DataFrame:
    """The first pass's transactions, and the retry's of documents that had none."""
    return first.unionByName(retry.join(first.select(on).distinct(), on, "left_anti"))
