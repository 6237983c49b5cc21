"""Sinks: responses as JSON, notes, usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import balance_reports, opening_balances

FIELDS = ("tran_date", "value_date", "narration", "withdrawal", "deposit", "balance")


def responses(metadata: DataFrame, transactions: DataFrame, on: str = "doc_id") -> DataFrame:
    """``on, response``: metadata, opening balance, transactions in order and the validation report of each document, as JSON text."""
    key = F.struct(F.col("tran_date").isNull().alias("undated"), "tran_date", "seq", *[f for f in FIELDS if f != "tran_date"])
    listed = transactions.groupBy(on).agg(F.array_sort(F.collect_list(key)).alias("t"))
    listed = listed.select(on, F.transform("t", lambda t: F.struct(*[t[f].alias(f) for f in FIELDS])).alias("transactions"))
    opening = opening_balances(transactions, on)
    with_opening = transactions.join(opening.withColumnRenamed("opening_balance", "_opening"), on)
    reports = balance_reports(with_opening, F.col("_opening"), on=on).select(on, F.struct("status", "issues").alias("validation"))
    empty = F.struct(F.lit("empty").alias("status"), F.from_json(F.lit("[]"), "array<struct<seq:bigint,expected_balance:decimal(18,2),actual_balance:decimal(18,2)>>").alias("issues"))
    meta = metadata.select(on, F.struct(*[c for c in metadata.columns if c != on]).alias("metadata"))
    joined = meta.join(opening, on, "left").join(listed, on, "left").join(reports, on, "left")
    kind = "array<struct<" + ",".join(f"{f}:{dict(transactions.dtypes)[f]}" for f in FIELDS) + ">>"
    body = F.struct("metadata", "opening_balance", F.coalesce("transactions", F.from_json(F.lit("[]"), kind)).alias("transactions"), F.coalesce(F.col("validation"), empty).alias("validation"))
    return joined.select(on, F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def write_responses(df: DataFrame, path: str) -> None:
    """One JSON line for each document."""
    df.select("response").write.mode("overwrite").text(path)


def append_notes(notes: DataFrame, path: str) -> None:
    notes.select("suggestion", "reason").write.mode("append").json(path)


def append_usage(events: DataFrame, path: str) -> None:
    """Usage is appended as events; totals are queries over them, so nothing is overwritten."""
    events.write.mode("append").partitionBy("day").parquet(path) if "day" in events.columns else events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def reset_usage(empty: DataFrame, path: str) -> None:
    """Truncates the usage events."""
    empty.limit(0).withColumn("day", F.to_date("ts")).write.mode("overwrite").parquet(path)
