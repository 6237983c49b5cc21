"""The statement pipeline: lines and table rows of documents to metadata, transactions, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, json_salvage, metadata
from ..operators import blocks, dedup, ledger, lines
from ..sources import sinks

MODEL_SCHEMA = "array<map<string,string>>"


def document_texts(layout: DataFrame, on: str = "doc_id") -> DataFrame:
    """``on, text``: a document's lines joined by line ends."""
    both = layout.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    return both.select(on, F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("text"))


def statement_metadata(layout: DataFrame, table: DataFrame, on: str = "doc_id") -> DataFrame:
    """Metadata from text; balances that have no label there, from the table's balance column."""
    meta = metadata.metadata_of(document_texts(layout, on), on=on)
    balances = metadata.balances_of_rows(table, on).withColumnsRenamed({"opening_balance": "_o", "closing_balance": "_c"})
    joined = meta.join(balances, on, "left")
    return joined.withColumns({"opening_balance": F.coalesce("opening_balance", "_o"), "closing_balance": F.coalesce("closing_balance", "_c")}).drop("_o", "_c")


def model_transactions(answers: DataFrame, on: str = "doc_id") -> DataFrame:
    """Transactions of model answers (``on, raw``): salvaged JSON, its list under a known key or itself, coerced.

    Documents whose answer has none are absent; the parser's second pass takes them.
    """
    filled = lambda x: F.get(F.filter(F.array(x), lambda l: F.size(l) > 0), F.lit(0))

    def listed(value: Column) -> Column:
        lists = [F.from_json(F.get_json_object(value, f"$.{k}"), MODEL_SCHEMA) for k in coerce.LIST_KEYS]
        return F.coalesce(*map(filled, [*lists, F.when(value.startswith("["), F.from_json(value, MODEL_SCHEMA))]))

    found = F.get(F.transform(F.array(json_salvage.salvage_json(F.col("raw"))), listed), F.lit(0))  # an answer is salvaged once
    rows = answers.select(on, F.posexplode(found).alias("seq", "rec"))
    return coerce.coerce_rows(rows.withColumn("seq", F.col("seq").cast("bigint")))


def transactions(layout: DataFrame, table: DataFrame, answers: DataFrame | None = None, on: str = "doc_id") -> DataFrame:
    """The model's transactions without duplicates, and the block parser's for documents where it gave none; normalised."""
    own = lambda rows: blocks.parse_blocks(lines.clean_lines(rows), on)
    if answers is None:
        return ledger.normalize(own(blocks.source_lines(table, layout, on)))
    model = model_transactions(answers, on)
    answered = model.select(on).distinct()
    without = [x.join(answered, on, "left_anti") for x in (table, layout)]  # before the parser: it reads no answered document's lines
    others = own(blocks.source_lines(*without, on))
    return ledger.normalize(dedup.drop_fuzzy(model, on=on).drop("slot").unionByName(others.select(*model.columns)))


def parse(layout: DataFrame, table: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, on: str = "doc_id") -> DataFrame:
    """``on, response`` of documents from their lines and rows. ``model``: payloads (``on, payload``) to answers (``on, raw``)."""
    empty = layout.select(on, "pos", "text").where(F.lit(False))
    table_lines = table.select(on, F.col("row_no").alias("pos"), F.array_join("cells", " | ").alias("text"))
    answers = model(lines.payloads(layout.select(on, "pos", "text"), table_lines, empty, on)) if model else None
    return sinks.responses(statement_metadata(layout, table, on), transactions(layout, table, answers, on), on)
