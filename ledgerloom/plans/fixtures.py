"""Statements rendered from the driver's tables, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEDGER_SQL = """
base AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS tran_date,
    CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus IN ('F', 'O') AS is_deposit, o_orderpriority AS narration
  FROM orders
), ledger AS (
  SELECT doc_id, seq, tran_date, narration,
    CASE WHEN is_deposit THEN price END AS deposit, CASE WHEN NOT is_deposit THEN price END AS withdrawal,
    CASE WHEN seq % 53 = 0 THEN NULL ELSE
      CAST(sum(CASE WHEN is_deposit THEN price ELSE -price END) OVER (PARTITION BY doc_id ORDER BY tran_date, seq ROWS UNBOUNDED PRECEDING)
        + CASE WHEN seq % 97 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) END AS balance
  FROM base
)"""


def ledger(orders: DataFrame) -> DataFrame:
    """Orders as bookings by customer: running balances, 5.00 off at each 97th key, unknown at each 53rd."""
    price, deposit = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus").isin("F", "O")
    base = orders.select(
        F.col("o_custkey").cast("string").alias("doc_id"),
        F.col("o_orderkey").alias("seq"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("tran_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("value_date"),
        F.col("o_orderpriority").alias("narration"),
        F.when(deposit, price).alias("deposit"),
        F.when(~deposit, price).alias("withdrawal"),
    )
    run = Window.partitionBy("doc_id").orderBy("tran_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce("deposit", -F.col("withdrawal"))).over(run) + F.when(F.col("seq") % 97 == 0, 5).otherwise(0)
    return base.withColumn("balance", F.when(F.col("seq") % 53 != 0, total.cast("decimal(18,2)")))


STYLED_SQL = """
styled AS (
  SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS seq,
    CASE o_orderkey % 8
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 3 THEN strftime(o_orderdate, '%d-%m-%y') WHEN 4 THEN 'on ' || strftime(o_orderdate, '%d/%m/%Y') || ' at 9'
      WHEN 5 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 6 THEN strftime(o_orderdate, '%d %B %Y') ELSE '31-02-2020' END AS raw
  FROM orders
)"""


def styled_dates(orders: DataFrame) -> DataFrame:
    """``doc_id, seq, raw``: each order's date in one of eight styles, two of which no parser accepts."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    style = lambda pattern: F.date_format(d, pattern)
    raw = (
        F.when(k == 0, style("yyyy-MM-dd")).when(k == 1, style("dd-MM-yyyy")).when(k == 2, style("dd/MM/yyyy")).when(k == 3, style("dd-MM-yy"))
        .when(k == 4, F.concat(F.lit("on "), style("dd/MM/yyyy"), F.lit(" at 9"))).when(k == 5, style("dd/MM/yy")).when(k == 6, style("dd MMMM yyyy"))
        .otherwise("31-02-2020")
    )
    return orders.select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("seq"), raw.alias("raw"))


CELLS_SQL = """
cells AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_no,
    CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN ['total', NULL, ' see ', 'x']
      WHEN l_orderkey % 7 = 0 THEN ['n' || CAST(l_linenumber AS VARCHAR), NULL, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)]
      ELSE [l_returnflag, ' ' || l_linestatus || ' ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)] END AS cells
  FROM lineitem
)"""


def cells(lineitem: DataFrame) -> DataFrame:
    """``doc_id, row_no, cells``: line items as table rows by order, some ragged, some without numbers."""
    text = lambda c: F.col(c).cast("string")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    none = F.lit(None).cast("string")
    made = (
        F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 2), F.array(F.lit("total"), none, F.lit(" see "), F.lit("x")))
        .when(F.col("l_orderkey") % 7 == 0, F.array(F.concat(F.lit("n"), text("l_linenumber")), none, price))
        .otherwise(F.array(F.col("l_returnflag"), F.concat(F.lit(" "), "l_linestatus", F.lit(" ")), F.col("l_quantity").cast("bigint").cast("string"), price))
    )
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return lineitem.select(text("l_orderkey").alias("doc_id"), nth.cast("bigint").alias("row_no"), made.alias("cells"))


HEADERS_SQL = r"""
heads AS (
  SELECT CAST(c_custkey AS VARCHAR) AS doc_id,
    CASE c_custkey % 4 WHEN 0 THEN 'Axis Bank Ltd' WHEN 1 THEN 'State Bank of India' WHEN 2 THEN 'hdfc bank' ELSE 'Some Credit Union' END || chr(10) ||
    CASE c_custkey % 3 WHEN 0 THEN 'A/C : ' WHEN 1 THEN 'Account No. ' ELSE 'Ref ' END || CAST(1000000000 + c_custkey AS VARCHAR) || chr(10) ||
    'IFSC ABCD0' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || ' MICR ' || CAST(100000000 + c_custkey AS VARCHAR) || chr(10) ||
    CASE WHEN c_custkey % 2 = 0 THEN 'Customer Name: ' || upper(c_mktsegment) || '  ONE' ELSE upper(c_mktsegment) END || chr(10) ||
    'Statement from 0' || CAST(1 + c_custkey % 9 AS VARCHAR) || '/05/2020 to 31-05-2020' || chr(10) ||
    'Opening Balance: ' || CAST(c_custkey AS VARCHAR) || ',100.50' || chr(10) || 'Closing Balance - ' || CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) AS VARCHAR) || chr(10) AS text
  FROM customer
)"""


def headers(customer: DataFrame) -> DataFrame:
    """``doc_id, text``: a statement's head for each customer."""
    k, nl, text = F.col("c_custkey"), F.lit("\n"), lambda c: c.cast("string")
    bank = F.when(k % 4 == 0, "Axis Bank Ltd").when(k % 4 == 1, "State Bank of India").when(k % 4 == 2, "hdfc bank").otherwise("Some Credit Union")
    label = F.when(k % 3 == 0, "A/C : ").when(k % 3 == 1, "Account No. ").otherwise("Ref ")
    name = F.when(k % 2 == 0, F.concat(F.lit("Customer Name: "), F.upper("c_mktsegment"), F.lit("  ONE"))).otherwise(F.upper("c_mktsegment"))
    return customer.select(
        text(k).alias("doc_id"),
        F.concat(
            bank, nl, label, text(k + 1000000000), nl,
            F.lit("IFSC ABCD0"), F.lpad(text(k % 1000000), 6, "0"), F.lit(" MICR "), text(k + 100000000), nl,
            name, nl,
            F.lit("Statement from 0"), text(1 + k % 9), F.lit("/05/2020 to 31-05-2020"), nl,
            F.lit("Opening Balance: "), text(k), F.lit(",100.50"), nl,
            F.lit("Closing Balance - "), text(F.abs(F.col("c_acctbal").cast("decimal(18,2)"))), nl,
        ).alias("text"),
    )


COPIES_SQL = LEDGER_SQL + """, copies AS (
  SELECT doc_id, seq * 2 AS seq, tran_date, narration, deposit, withdrawal, balance FROM ledger
  UNION ALL
  SELECT doc_id, seq * 2 + 1, CASE WHEN seq % 70 = 0 THEN NULL ELSE tran_date END, ' ' || upper(narration) || '!',
    deposit, withdrawal, CASE WHEN seq % 20 = 0 THEN NULL ELSE balance END
  FROM ledger WHERE seq % 10 = 0
)"""


def with_copies(orders: DataFrame) -> DataFrame:
    """The ledger with each tenth booking again: other capitals and points, some without balance or date."""
    one = ledger(orders)
    own = one.select("doc_id", (F.col("seq") * 2).alias("seq"), "tran_date", "value_date", "narration", "withdrawal", "deposit", "balance")
    again = one.where("seq % 10 = 0").select(
        "doc_id", (F.col("seq") * 2 + 1).alias("seq"), F.when(F.col("seq") % 70 != 0, F.col("tran_date")).alias("tran_date"), "value_date",
        F.concat(F.lit(" "), F.upper("narration"), F.lit("!")).alias("narration"), "withdrawal", "deposit",
        F.when(F.col("seq") % 20 != 0, F.col("balance")).alias("balance"),
    )
    return own.unionByName(again)


def statement_lines(orders: DataFrame) -> DataFrame:
    """``doc_id, pos, text``: each booking as four lines: date, narration, amount, balance."""
    one = ledger(orders).select("doc_id", "tran_date", "seq", "narration", F.coalesce("deposit", "withdrawal").alias("amount"), F.coalesce("balance", F.lit(0).cast("decimal(18,2)")).alias("balance"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("tran_date", "seq")) - 1
    texts = F.array(F.date_format(F.to_date("tran_date"), "dd-MM-yyyy"), "narration", F.format_number("amount", 2), F.format_number(F.abs("balance"), 2))
    return one.withColumn("_nth", nth).select("doc_id", "_nth", F.posexplode(texts).alias("part", "text")).select("doc_id", (F.col("_nth") * 4 + F.col("part")).cast("bigint").alias("pos"), "text")


METRICS_SQL = """
metrics AS (
  SELECT event_id AS request_id, ts, CAST(1 + user_id % 12 AS INT) AS page_count, value AS total_duration_ms, event_id % 3 = 0 AS ocr_skipped,
    CAST(round(value) AS BIGINT) AS total_tokens, CAST(event_id % 40 AS BIGINT) AS transactions_extracted, CAST(event_id % 7 AS BIGINT) AS duplicates_removed
  FROM events
)"""


def metrics(events: DataFrame) -> DataFrame:
    """Events as requests with pages, durations, tokens and decisions."""
    return events.select(
        F.col("event_id").alias("request_id"), "ts", (1 + F.col("user_id") % 12).cast("int").alias("page_count"), F.col("value").alias("total_duration_ms"),
        (F.col("event_id") % 3 == 0).alias("ocr_skipped"), F.round(F.col("value")).cast("bigint").alias("total_tokens"),
        (F.col("event_id") % 40).alias("transactions_extracted"), (F.col("event_id") % 7).alias("duplicates_removed"),
    )


USAGE_SQL = """
usage AS (SELECT CAST(user_id AS VARCHAR) AS api_key_id, event_id, ts, CAST(floor(value) AS BIGINT) AS tokens FROM events)"""


def usage(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("api_key_id"), "event_id", "ts", F.floor("value").cast("bigint").alias("tokens"))
