"""Lines: flattening layouts, selections under a budget, repeated lines, context, payloads."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import clean_text, looks_like_transaction

TOP_LINES = 20
REPEATED_SHARE = 0.6
TAIL_CHARS = 1500
FALLBACK_CHARS = 20_000


def flatten_layout(layouts: DataFrame, on: str = "doc_id") -> DataFrame:
    """``on, page_no, block_no, line_no, text`` of a layout tree; empty lines go."""
    pages = layouts.select(on, F.posexplode("pages").alias("page_no", "blocks"))
    blocks = pages.select(on, "page_no", F.posexplode("blocks").alias("block_no", "block"))
    rows = blocks.where("block.lines is not null").select(on, "page_no", "block_no", F.posexplode("block.lines").alias("line_no", "line"))
    joined = F.array_join(F.transform("line.spans", lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return rows.select(on, "page_no", "block_no", "line_no", clean_text(joined).alias("text")).where("text <> ''")


def explode_lines(texts: DataFrame, on: str = "doc_id", text: str = "text") -> DataFrame:
    """``on, pos, text``: the non-empty lines of each text."""
    return texts.select(on, F.posexplode(T.lines(F.col(text))).alias("pos", "text"))


def clean_lines(rows: DataFrame) -> DataFrame:
    """Without noise lines; texts stripped."""
    return rows.where(~T.is_noise(F.col("text"))).withColumn("text", T.strip(F.col("text")))


def within_budget(rows: DataFrame, budget: Column | int, on: str = "doc_id") -> DataFrame:
    """The longest beginning of each document's lines whose lengths sum up to the budget at most."""
    upto = Window.partitionBy(on).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_upto", F.sum(F.length("text")).over(upto)).where(F.col("_upto") <= budget).drop("_upto")


def relevant_lines(rows: DataFrame, budget: Column | int, on: str = "doc_id") -> DataFrame:
    """Lines with a digit (all lines of a document that has none), as far as the budget goes."""
    digit = F.col("text").rlike(r"\d")
    any_digit = F.max(digit).over(Window.partitionBy(on))
    return within_budget(rows.withColumn("_keep", digit | ~any_digit).where("_keep").drop("_keep"), budget, on)


def repeated_lines(rows: DataFrame, on: str = "doc_id", page: str = "page_no", share: float = REPEATED_SHARE) -> DataFrame:
    """``on, text`` of lines of more than three characters that are among the first 20 of at least a share of the pages."""
    top = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(on, page).orderBy("pos"))).where(F.col("_nth") <= TOP_LINES)
    pages = rows.select(on, page).distinct().groupBy(on).agg(F.count(F.lit(1)).alias("_pages"))
    counts = top.select(on, page, "text").distinct().groupBy(on, "text").agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(pages, on).where((F.col("_n") / F.col("_pages") >= share) & (F.length("text") > 3)).select(on, "text")


def without_repeated(rows: DataFrame, on: str = "doc_id", page: str = "page_no") -> DataFrame:
    return rows.join(repeated_lines(rows, on, page), [on, "text"], "left_anti").where(~F.col("text").rlike(T.PAGE_OF))


def contained_share(rows: DataFrame, layouts: DataFrame, least_length: int, on: str = "doc_id") -> DataFrame:
    """``share`` of each document's lines (longer than ``least_length``) that its layout text contains."""
    inside = F.coalesce(F.col("layout").contains(F.col("text")), F.lit(False)).cast("int")
    return rows.where(F.length("text") > least_length).join(layouts, on, "left").groupBy(on).agg(F.avg(inside).alias("share"))


def table_repeats_layout(rows: DataFrame, layouts: DataFrame, on: str = "doc_id") -> DataFrame:
    """``on, duplicate``: at least 0.8 of the table's lines are in the layout; false without lines."""
    s = contained_share(rows, layouts, 3, on)
    return layouts.select(on).join(s, on, "left").select(on, F.coalesce(F.col("share") >= 0.8, F.lit(False)).alias("duplicate"))


def ocr_repeats_layout(rows: DataFrame, layouts: DataFrame, on: str = "doc_id") -> DataFrame:
    """``on, duplicate``: at least 0.6 of the recognised lines are in the layout; true without lines."""
    s = contained_share(rows, layouts, 2, on)
    return layouts.select(on).join(s, on, "left").select(on, F.coalesce(F.col("share") >= 0.6, F.lit(True)).alias("duplicate"))


def unique_ocr_lines(rows: DataFrame, layouts: DataFrame, on: str = "doc_id") -> DataFrame:
    """Recognised lines; of documents whose recognised text repeats the layout only those that the layout does not contain."""
    flag = ocr_repeats_layout(rows, layouts, on)
    inside = F.coalesce(F.col("layout").contains(F.col("text")), F.lit(False))
    return rows.join(layouts, on, "left").join(flag, on, "left").where(~(F.coalesce("duplicate", F.lit(False)) & inside)).select(*rows.columns)


def with_context(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """Lines that look like transactions, up to three lines after each (up to the next such line), and the line before.

    Context lines have more than three characters; a line before is no page mark. ``is_match`` marks the lines themselves.
    """
    w = Window.partitionBy(on).orderBy("pos")
    hit = looks_like_transaction(F.col("text"))
    m = rows.withColumn("is_match", hit)
    m = m.withColumn("_row", F.row_number().over(w))
    after = F.col("_row") - F.last(F.when(F.col("is_match"), F.col("_row")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("_after", after).withColumn("_next", F.lead("is_match").over(w))
    long = F.length("text") > 3
    keep = F.col("is_match") | (long & F.col("_after").between(1, 3)) | (long & F.coalesce("_next", F.lit(False)) & ~F.col("text").rlike(r"(?i)^page\s+\d+"))
    return m.where(keep).drop("_row", "_after", "_next")


def _payload(layout: list[str], table: list[str], ocr: list[str], fallback: str, is_hit) -> str:
    """One document's compact text: table rows, matches with their context, recognised matches, a tail of the rest."""
    first: list[str] = []
    known: set[str] = set()

    def add(line: str, at: int | None = None) -> None:
        if line not in known:
            known.add(line)
            first.insert(len(first) if at is None else at, line)

    for line in table:
        first.append(line)
        known.add(line)
    hits = [is_hit(line) for line in layout]
    for i, line in enumerate(layout):
        if not hits[i]:
            continue
        add(line)
        for k in range(i + 1, min(i + 4, len(layout))):
            if hits[k]:
                break
            if len(layout[k]) > 3:
                add(layout[k])
        if i and len(layout[i - 1]) > 3 and not _PAGE.match(layout[i - 1]):
            add(layout[i - 1], first.index(line))
    rest = "\n".join(line for line in layout if line not in known)[:TAIL_CHARS]
    parts = ["\n".join(first), "\n".join(line for line in ocr if is_hit(line)), rest]
    return "\n\n".join(p for p in parts if p).strip() or fallback[:FALLBACK_CHARS]


_PAGE = re.compile(r"page\s+\d+", re.IGNORECASE)
_HIT = re.compile(f"{T.LINE_DATE}|{T.AMOUNT}")


def payloads(layout: DataFrame, table: DataFrame, ocr: DataFrame, on: str = "doc_id") -> DataFrame:
    """``on, payload`` of documents from their ``on, pos, text`` lines of three sources.

    Filters and containment are joins; only the order-dependent assembly of one document's lines runs in Python.
    """
    clean = layout.where(~F.col("text").rlike(T.PAGE_OF))
    whole = lambda rows, name: rows.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias(name))
    text = lambda name: F.transform(name, lambda s: s["text"])
    layouts = whole(clean, "l").select(on, F.array_join(text("l"), "\n").alias("layout"))
    repeats = table_repeats_layout(table, layouts, on)
    own_table = table.join(repeats, on, "left").where(~F.coalesce("duplicate", F.lit(False))).drop("duplicate")
    own_ocr = unique_ocr_lines(ocr, layouts, on)
    docs = whole(clean, "l").join(whole(own_table, "t"), on, "full").join(whole(own_ocr, "o"), on, "full").join(whole(layout, "raw"), on, "left")
    empty = F.array().cast("array<string>")
    docs = docs.select(on, *[F.coalesce(text(c), empty).alias(c) for c in ("l", "t", "o")], F.coalesce(F.array_join(text("raw"), "\n"), F.lit("")).alias("raw"))

    @F.pandas_udf("string")
    def build(layout: pd.Series, table: pd.Series, ocr: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([_payload(list(a), list(b), list(c), d, lambda s: bool(_HIT.search(s))) for a, b, c, d in zip(layout, table, ocr, raw, strict=True)], dtype=object)

    return docs.select(on, build("l", "t", "o", "raw").alias("payload"))


def truncate_by_priority(rows: DataFrame, budget: int, on: str = "doc_id") -> DataFrame:
    """Table lines, then layout, then recognised lines, each as far as the budget that its predecessors left goes; digits first where
    a source has them. ``source`` is one of table, layout, ocr."""
    left = F.lit(budget)
    out = None
    used = None
    for source in ("table", "layout", "ocr"):
        own = rows.where(F.col("source") == source)
        if used is not None:
            own = own.join(used, on, "left").withColumn("_left", F.lit(budget) - F.coalesce("_used", F.lit(0))).drop("_used")
            kept = within_budget(own, F.col("_left"), on) if source == "table" else relevant_lines(own.where("_left > 0"), F.col("_left"), on)
            kept = kept.drop("_left")
        else:
            kept = within_budget(own, left, on)
        out = kept if out is None else out.unionByName(kept)
        used = out.groupBy(on).agg(F.sum(F.length("text")).alias("_used"))
    return out


def truncated_documents(rows: DataFrame, budget: int, on: str = "doc_id") -> DataFrame:
    """``on, n_kept, truncated``: whether ``truncate_by_priority`` left out a line of a document (blank ones of text sources aside)."""
    counted = (F.col("source") == "table") | (T.strip(F.col("text")) != "")
    had = rows.groupBy(on, "source").agg(F.sum(counted.cast("bigint")).alias("had"))
    kept = truncate_by_priority(rows, budget, on).groupBy(on, "source").agg(F.count(F.lit(1)).alias("kept"))
    both = had.join(kept, [on, "source"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return both.groupBy(on).agg(F.sum("kept").alias("n_kept"), F.max(F.col("kept") < F.col("had")).alias("truncated"))
