"""Chunks of documents under character budgets."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .grouped import map_groups

# Fixed values of the adaptive strategy.
FORCE_CHUNK_ABOVE = 60_000
TARGET_CHUNK = 18_000
PAGES_PER_CHUNK = 5
MAX_CHUNKS = 10
ORDER = ("table", "ocr", "layout")


def char_totals(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """``table_chars, ocr_chars, layout_chars, total_chars`` of each document."""
    size = F.length("text")
    agg = [F.coalesce(F.sum(F.when(F.col("source") == s, size)), F.lit(0)).cast("long").alias(f"{s}_chars") for s in ORDER]
    return rows.groupBy(on).agg(*agg).withColumn("total_chars", F.col("table_chars") + F.col("ocr_chars") + F.col("layout_chars"))


def chunk_count(total: Column, settings: Settings = DEFAULTS) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(settings.max_chunks), F.ceil(total / settings.chunk_chars))).cast("int")


def fill_chunks(sizes: dict[str, list[int]], total: int, n: int, overlap: int) -> list[tuple[int, str, int, bool]]:
    """(chunk, source, position, is overlap): greedy filling of n equal budgets, table rows to the budget, the others to 1.2 of it.

    A chunk but the last also shows the next ``overlap`` lines of each source, which stay to be placed; what no chunk took goes to the last.
    """
    at = dict.fromkeys(ORDER, 0)
    out: list[tuple[int, str, int, bool]] = []
    budget = total / n
    for chunk in range(n):
        filled = 0
        for source in ORDER:
            limit = budget if source == "table" else budget * 1.2
            while at[source] < len(sizes[source]) and filled < limit:
                filled += sizes[source][at[source]]
                out.append((chunk, source, at[source], False))
                at[source] += 1
        if chunk < n - 1:
            for source in ORDER:
                out += [(chunk, source, p, True) for p in range(at[source], min(len(sizes[source]), at[source] + overlap))]
    for source in ORDER:
        out += [(n - 1, source, p, False) for p in range(at[source], len(sizes[source]))]
    return out


def split_chunks(rows: DataFrame, settings: Settings = DEFAULTS, on: str = "doc_id") -> DataFrame:
    """``on, chunk_index, source, pos, text, is_overlap`` of ``on, source, pos, text`` lines: one document's lines at a time."""

    def run(group: Iterator[tuple]) -> Iterator[tuple]:
        own: dict[str, list[tuple]] = {s: [] for s in ORDER}
        for row in group:
            if row[1] in own:
                own[row[1]].append(row)
        sizes = {s: [len(row[3] or "") for row in own[s]] for s in ORDER}
        total = sum(map(sum, sizes.values()))
        n = max(1, min(settings.max_chunks, math.ceil(total / settings.chunk_chars)))
        for chunk, source, p, overlap in fill_chunks(sizes, total, n, settings.overlap_lines) if total else []:
            who, _, pos, text = own[source][p]
            yield (who, chunk, source, pos, text, overlap)

    kinds = dict(rows.dtypes)
    schema = [(on, kinds[on]), ("chunk_index", "int"), ("source", "string"), ("pos", kinds["pos"]), ("text", "string"), ("is_overlap", "boolean")]
    return map_groups(rows.select(on, "source", "pos", "text"), [on], ["pos"], run, schema)


def even_chunks(rows: DataFrame, budget: int, on: str = "doc_id") -> DataFrame:
    """Chunks by the running length before each line, without Python: no chunk waits for another."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(on).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("chunk_index", F.floor(before / budget).cast("int"))


def strategy(chars: Column, pages: Column) -> Column:
    """``struct(strategy, chunk_count, pages_per_chunk)``: one shot up to 60,000 characters, else the fewest chunks by pages, characters or the cap."""
    n = F.least(F.ceil(pages / PAGES_PER_CHUNK), F.ceil(chars / TARGET_CHUNK), F.lit(MAX_CHUNKS)).cast("int")
    large = chars > FORCE_CHUNK_ABOVE
    count = F.when(large, F.greatest(n, F.lit(1))).otherwise(1)
    return F.struct(
        F.when(large, F.lit("chunked")).otherwise(F.lit("single_shot")).alias("strategy"),
        count.cast("int").alias("chunk_count"),
        F.when(large, F.ceil(pages / count)).otherwise(pages).cast("int").alias("pages_per_chunk"),
    )


def page_chunks(pages: DataFrame, on: str = "doc_id") -> DataFrame:
    """``on, chunk_id, page_no, is_overlap`` of pages with ``pages_per_chunk``: from the second chunk on, the page before comes along."""
    nth = F.row_number().over(Window.partitionBy(on).orderBy("page_no")) - 1
    own = pages.withColumn("_nth", nth).withColumn("chunk_id", F.floor(F.col("_nth") / F.col("pages_per_chunk")).cast("int"))
    n = F.max("chunk_id").over(Window.partitionBy(on))
    last = (F.col("_nth") + 1) % F.col("pages_per_chunk") == 0
    both = own.withColumn("_n", n).withColumn("_to", F.when(last & (F.col("chunk_id") < F.col("_n")), F.array("chunk_id", F.col("chunk_id") + 1)).otherwise(F.array("chunk_id")))
    out = both.select(*pages.columns, F.col("chunk_id").alias("_own"), F.explode("_to").alias("chunk_id"))
    return out.withColumn("is_overlap", F.col("_own") != F.col("chunk_id")).drop("_own")


def batches(rows: DataFrame, size: int, on: str = "doc_id", order: str = "pos") -> DataFrame:
    """Fixed-size batches in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(on).orderBy(order)) - 1) / size).cast("int"))


def route_by_size(payloads: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(payloads for one call, payloads to be chunked)."""
    fits = F.length("payload") <= settings.max_payload_chars
    return payloads.where(fits), payloads.where(~fits)
