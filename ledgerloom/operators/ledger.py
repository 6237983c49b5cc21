"""Normalising, ordering and validating ledgers: one shuffle by document for all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.amounts import money, table_number
from ..functions.dates import normalizer_date

MONEY = "decimal(18,2)"


def in_order(on: str = "doc_id") -> WindowSpec:
    """By date, undated rows last, then by place."""
    return Window.partitionBy(on).orderBy(F.col("tran_date").asc_nulls_last(), F.col("seq"))


def normalize(rows: DataFrame) -> DataFrame:
    """Dates to ISO (the value date falls back on the date), amounts in text to numbers; other columns stay."""
    tran = normalizer_date(F.col("tran_date").cast("string"))
    value = F.when(F.coalesce(F.col("value_date"), F.lit("")) != "", normalizer_date(F.col("value_date").cast("string"))).otherwise(tran)
    kinds = dict(rows.dtypes)
    number = lambda c: table_number(F.col(c)) if kinds[c] == "string" else F.col(c).cast("double")
    return rows.withColumns({"tran_date": tran, "value_date": value} | {c: number(c) for c in ("withdrawal", "deposit", "balance")})


def sorted_ledger(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """With each row's ``position`` in its document's order, from 0."""
    return rows.withColumn("position", F.row_number().over(in_order(on)) - 1)


def opening_balances(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """The balance of each document's first row in order, null included."""
    key = F.struct(F.col("tran_date").isNull().alias("undated"), F.coalesce("tran_date", F.lit("")).alias("d"), "seq")
    return rows.groupBy(on).agg(F.min_by("balance", key).alias("opening_balance"))


def expected_balances(rows: DataFrame, opening: Column, on: str = "doc_id") -> DataFrame:
    """With ``expected_balance``: the last reported balance before (else ``opening``) + deposit - withdrawal; null without either."""
    before = F.last(money(F.col("balance")), ignorenulls=True).over(in_order(on).rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast(MONEY)
    expected = F.coalesce(before, money(opening)) + F.coalesce(money(F.col("deposit")), zero) - F.coalesce(money(F.col("withdrawal")), zero)
    return rows.withColumn("expected_balance", expected.cast(MONEY))


def balance_issues(rows: DataFrame, opening: Column, tolerance: float = DEFAULTS.balance_tolerance, on: str = "doc_id") -> DataFrame:
    """Rows whose reported balance is off the expected one by more than the tolerance."""
    e = expected_balances(rows, opening, on)
    off = F.abs(F.col("expected_balance") - money(F.col("balance"))) > F.lit(tolerance).cast(MONEY)
    return e.where(F.col("balance").isNotNull() & off).withColumn("actual_balance", money(F.col("balance")))


def balance_reports(rows: DataFrame, opening: Column, tolerance: float = DEFAULTS.balance_tolerance, on: str = "doc_id") -> DataFrame:
    """``status`` (valid, invalid) and the issues in order, of each document; a document without rows has no report (empty)."""
    e = expected_balances(rows, opening, on)
    off = F.coalesce(F.col("balance").isNotNull() & (F.abs(F.col("expected_balance") - money(F.col("balance"))) > F.lit(tolerance).cast(MONEY)), F.lit(False))
    issue = F.struct(F.col("tran_date").isNull().alias("undated"), "tran_date", "seq", "expected_balance", money(F.col("balance")).alias("actual_balance"))
    out = e.groupBy(on).agg(F.array_sort(F.collect_list(F.when(off, issue))).alias("issues"), F.count(F.lit(1)).alias("n_transactions"))
    slim = F.transform("issues", lambda s: F.struct(s["seq"].alias("seq"), s["expected_balance"].alias("expected_balance"), s["actual_balance"].alias("actual_balance")))
    return out.select(on, F.when(F.size("issues") == 0, F.lit("valid")).otherwise(F.lit("invalid")).alias("status"), slim.alias("issues"), "n_transactions")


def infer_sides(blocks: DataFrame, on: str = "doc_id") -> DataFrame:
    """Deposit or withdrawal of blocks with (amount, balance): a deposit if the balance rose or none was known before."""
    known = F.last(F.when(F.col("balance") != 0, F.col("balance")), ignorenulls=True).over(Window.partitionBy(on).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rose = known.isNull() | (F.col("balance") > known)
    return blocks.withColumn("_rose", rose).withColumns({"deposit": F.when(F.col("_rose"), F.col("amount")), "withdrawal": F.when(~F.col("_rose"), F.col("amount"))}).drop("_rose")
