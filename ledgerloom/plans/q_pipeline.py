"""Queries on payload shapes and on the whole statement pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions.text import bytes_as_json_text
from ..operators import chunking
from . import fixtures as X
from . import statements
from .registry import Tables, query


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"__bytes_base64":"/v8="}' ELSE text END AS shown FROM documents""")
def q_bytes_json(t: Tables) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FEFF"))).otherwise(F.col("text").cast("binary"))
    return t.documents.select("doc_id", bytes_as_json_text(raw).alias("shown"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'transactions' WHEN 1 THEN 'items' WHEN 2 THEN 'data' END AS key FROM events""")
def q_payload_keys(t: Tables) -> DataFrame:
    k, empty = F.col("event_id") % 4, F.array().cast("array<string>")
    at = lambda n, name: F.when(k == n, F.array(F.lit(name))).otherwise(empty)
    found = coerce.listed({"transactions": at(0, "transactions"), "items": at(1, "items"), "data": at(2, "data")})
    return t.events.select("event_id", F.get(found, F.lit(0)).alias("key"))


@query("SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS request_id FROM documents")
def q_request_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12).alias("request_id"))


@query("""SELECT source, count(*) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM documents GROUP BY source""")
def q_metrics_projection(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.sum(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines")
    )


@query("""SELECT CASE WHEN length(text) <= 25000 THEN 'single' ELSE 'chunked' END AS branch, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def q_route_by_size(t: Tables) -> DataFrame:
    one, many = chunking.route_by_size(t.documents.select("doc_id", F.col("text").alias("payload")))
    both = one.withColumn("branch", F.lit("single")).unionByName(many.withColumn("branch", F.lit("chunked")))
    return both.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).cast("bigint").alias("n_chars"))


ANSWERS_SQL = f"""{X.LEDGER_SQL}, answered AS (SELECT * FROM ledger)"""


def _answers(orders: DataFrame) -> DataFrame:
    """Answers as a model would give them for every document: text around JSON, other keys."""
    rows = X.ledger(orders)
    rec = F.to_json(F.struct(F.col("tran_date").alias("date"), F.concat_ws(" ", F.col("narration"), F.col("seq").cast("string")).alias("particulars"), F.col("withdrawal").alias("debit"), F.col("deposit").alias("credit"), F.col("balance").alias("bal")))
    listed = rows.select("doc_id", F.struct("tran_date", "seq", rec.alias("rec")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("l"))
    body = F.concat(F.lit('Here: {"items": ['), F.array_join(F.transform("l", lambda s: s["rec"]), ", "), F.lit("]} done"))
    return listed.select("doc_id", body.alias("raw"))


def _partial_answers(orders: DataFrame) -> DataFrame:
    """The same, but empty lists for documents of odd number: the model found nothing there."""
    return _answers(orders).withColumn("raw", F.when(F.col("doc_id").cast("bigint") % 2 == 0, F.col("raw")).otherwise(F.lit('Sorry. {"items": []}')))


@query(f"""WITH {ANSWERS_SQL} SELECT doc_id, count(*) AS n, count(balance) AS with_balance, CAST(sum(coalesce(deposit, 0)) AS DECIMAL(18,2)) AS deposits,
  CAST(sum(coalesce(withdrawal, 0)) AS DECIMAL(18,2)) AS withdrawals, min(tran_date) AS first_date FROM answered GROUP BY doc_id""")
def q_model_answers(t: Tables) -> DataFrame:
    """Salvage, key fallback and coercion of model answers."""
    m = statements.model_transactions(_answers(t.orders))
    money = lambda c: F.sum(F.coalesce(F.col(c).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)")
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("with_balance"), money("deposit").alias("deposits"), money("withdrawal").alias("withdrawals"), F.min("tran_date").alias("first_date"))


@query(f"WITH {ANSWERS_SQL} SELECT doc_id, count(*) AS n, CAST(doc_id AS BIGINT) % 2 = 0 AS from_model FROM ledger GROUP BY doc_id")
def q_fallback_chain(t: Tables) -> DataFrame:
    """The model's transactions, and the block parser's for documents that it has no answer for."""
    done = statements.transactions(X.statement_lines(t.orders), X.cells(t.lineitem).where(F.lit(False)), _partial_answers(t.orders))
    return done.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("narration").rlike(r" \d+$")).alias("from_model"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'HDFC' AS bank_name, '2020-05-01' AS period_start, '2020-05-31' AS period_end, CAST(100 + c_custkey AS DOUBLE) AS opening_balance, CAST(7.25 AS DOUBLE) AS closing_balance FROM customer""")
def q_statement_metadata(t: Tables) -> DataFrame:
    """Metadata from text lines, the closing balance from the table."""
    k, doc = F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string").alias("doc_id")
    texts = F.array(F.lit("hdfc bank"), F.lit("Between 01/05/2020 to 31-05-2020"), F.concat(F.lit("Opening Balance: "), (F.col("c_custkey") + 100).cast("string"), F.lit(".00")), F.lit("x"))
    layout = t.customer.select(doc, F.posexplode(texts).alias("pos", "text"))
    rows = F.array(F.array(F.lit("Date"), F.lit("Balance (INR)")), F.array(k, F.lit("9.75")), F.array(k, F.lit("7.25")))
    table = t.customer.select(doc, F.posexplode(rows).alias("row_no", "cells"))
    return statements.statement_metadata(layout, table).select("doc_id", "bank_name", "period_start", "period_end", "opening_balance", "closing_balance")


@query(f"""WITH {X.LEDGER_SQL}, s AS (SELECT doc_id, CASE WHEN deposit IS NULL THEN 'w' ELSE 'd' END AS side, abs(coalesce(deposit, withdrawal)) AS amount FROM ledger),
n AS (SELECT doc_id, side, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT doc_id, side, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, side) AS nth FROM n)
SELECT doc_id, CAST(max(amount) AS DECIMAL(18,2)) AS top, any_value(m.side) AS commonest_side FROM s JOIN m USING (doc_id) WHERE nth = 1 GROUP BY doc_id""")
def q_top_booking(t: Tables) -> DataFrame:
    """The largest booking by document and its commonest side, of two equally common ones the first by name."""
    b = X.ledger(t.orders)
    amount = F.coalesce("deposit", "withdrawal")
    return b.groupBy("doc_id").agg(F.max(F.abs(amount)).alias("top"), F.mode(F.when(F.col("deposit").isNull(), "w").otherwise("d"), True).alias("commonest_side"))
