"""Loosely keyed records to the transaction schema, and metadata precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import model_number

# The keys under which a field is looked for, in order.
DATE_KEYS = ("tran_date", "value_date", "date", "txn_date", "transaction_date")
NARRATION_KEYS = ("narration", "description", "particulars", "remarks")
BALANCE_KEYS = ("balance", "running_balance", "bal")
DEBIT_KEYS = ("debit", "dr", "debit_amount")
CREDIT_KEYS = ("credit", "cr", "credit_amount")
DEBIT_TYPES = ("debit", "dr", "withdrawal")
METADATA_KEYS = ("account_number", "account_name", "bank_name", "ifsc", "micr", "period_start", "period_end", "opening_balance", "closing_balance")
LIST_KEYS = ("transactions", "items", "data")


def _filled(rec: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(rec, F.lit(k)), F.lit("")) for k in keys])


def coerce(rec: Column) -> Column:
    """``struct`` of the six transaction fields from a map of texts under any of the known keys.

    Date and narration: the first filled key. Balance: the first that is not null. Amounts: withdrawal and deposit; if both
    are null, debit and credit keys; if they are still null, amount by type, of which an unknown one is a deposit.
    """
    at = lambda k: F.try_element_at(rec, F.lit(k))
    date, narration = _filled(rec, DATE_KEYS), _filled(rec, NARRATION_KEYS)
    balance = model_number(F.coalesce(*[at(k) for k in BALANCE_KEYS]))
    w0, d0 = model_number(at("withdrawal")), model_number(at("deposit"))
    none0 = w0.isNull() & d0.isNull()
    w1 = F.when(none0, model_number(_filled(rec, DEBIT_KEYS))).otherwise(w0)
    d1 = F.when(none0, model_number(_filled(rec, CREDIT_KEYS))).otherwise(d0)
    none1 = w1.isNull() & d1.isNull()
    kind = F.lower(F.coalesce(F.nullif(at("type"), F.lit("")), at("txn_type"), F.lit("")))
    amount = model_number(at("amount"))
    debit = kind.isin(*DEBIT_TYPES)
    return F.struct(
        date.alias("tran_date"),
        date.alias("value_date"),
        narration.alias("narration"),
        F.when(none1 & debit, amount).otherwise(w1).alias("withdrawal"),
        F.when(none1 & ~debit, amount).otherwise(d1).alias("deposit"),
        balance.alias("balance"),
    )


def coerce_rows(rows: DataFrame, rec: str = "rec") -> DataFrame:
    """Rows with a map of texts to transactions; null maps go."""
    keys = [c for c in rows.columns if c != rec]
    return rows.where(F.col(rec).isNotNull()).select(*keys, coerce(F.col(rec)).alias("_t")).select(*keys, "_t.*")


def prefer(model: DataFrame, extracted: DataFrame, keys: tuple[str, ...] = METADATA_KEYS, on: str = "doc_id") -> DataFrame:
    """The model's value where it is not null (an empty text counts as a value), else the extracted one."""
    m, x = model.alias("m"), extracted.alias("x")
    return x.join(m, on, "left").select(on, *[F.coalesce(F.col(f"m.{k}"), F.col(f"x.{k}")).alias(k) for k in keys])


def merge_chunks(chunks: DataFrame, keys: tuple[str, ...] = METADATA_KEYS, on: str = "doc_id") -> DataFrame:
    """The first chunk's value that is neither null nor empty, for each key."""
    filled = lambda k: F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return chunks.groupBy(on).agg(*[F.min_by(F.when(filled(k), F.col(k)), F.when(filled(k), F.col("chunk_index"))).alias(k) for k in keys])


def listed(payload: dict[str, Column], keys: tuple[str, ...] = LIST_KEYS) -> Column:
    """The first of the arrays under the known keys that has elements."""
    return F.coalesce(*[F.when(F.size(payload[k]) > 0, payload[k]) for k in keys if k in payload])
