"""Queries on ledgers, dates, amounts, metadata and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amounts, coerce, dates, metadata
from ..functions.text import bucket_of_100
from ..operators import blocks, dedup, ledger, tables
from . import fixtures as X
from . import statements
from .registry import Tables, query

EXPECTED_SQL = X.LEDGER_SQL + """, expected AS (
  SELECT *, CAST(coalesce(last_value(balance IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY tran_date NULLS LAST, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(deposit, 0) - coalesce(withdrawal, 0) AS DECIMAL(18,2)) AS expected_balance
  FROM ledger
)"""
OPENING = 0.0


@query(f"WITH {EXPECTED_SQL} SELECT doc_id, seq, expected_balance, balance AS actual_balance FROM expected WHERE abs(expected_balance - balance) > 1")
def q_running_balance(t: Tables) -> DataFrame:
    return ledger.balance_issues(X.ledger(t.orders), F.lit(OPENING)).select("doc_id", "seq", "expected_balance", "actual_balance")


@query(f"""WITH {EXPECTED_SQL}
SELECT doc_id, CASE WHEN count(*) FILTER (WHERE abs(expected_balance - balance) > 1) = 0 THEN 'valid' ELSE 'invalid' END AS status,
  count(*) FILTER (WHERE abs(expected_balance - balance) > 1) AS n_issues, count(*) AS n_transactions FROM expected GROUP BY doc_id""")
def q_balance_status(t: Tables) -> DataFrame:
    r = ledger.balance_reports(X.ledger(t.orders), F.lit(OPENING))
    return r.select("doc_id", "status", F.size("issues").cast("bigint").alias("n_issues"), "n_transactions")


@query(f"WITH {X.LEDGER_SQL} SELECT doc_id, arg_min_null(balance, (tran_date, seq)) AS opening_balance FROM ledger GROUP BY doc_id")
def q_opening_balance(t: Tables) -> DataFrame:
    return ledger.opening_balances(X.ledger(t.orders))


ISO = {
    "Y-m-d": r"CASE WHEN regexp_full_match({x}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_strptime({x}, '%Y-%m-%d') END",
    "Y/m/d": r"CASE WHEN regexp_full_match({x}, '\d{{4}}/\d{{1,2}}/\d{{1,2}}') THEN try_strptime({x}, '%Y/%m/%d') END",
    "d-m-Y": r"CASE WHEN regexp_full_match({x}, '\d{{1,2}}-\d{{1,2}}-\d{{4}}') THEN try_strptime({x}, '%d-%m-%Y') END",
    "d/m/Y": r"CASE WHEN regexp_full_match({x}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN try_strptime({x}, '%d/%m/%Y') END",
    "d-m-y": r"CASE WHEN regexp_full_match({x}, '\d{{1,2}}-\d{{1,2}}-\d{{2}}') THEN try_strptime({x}, '%d-%m-%y') END",
    "d/m/y": r"CASE WHEN regexp_full_match({x}, '\d{{1,2}}/\d{{1,2}}/\d{{2}}') THEN try_strptime({x}, '%d/%m/%y') END",
    "d B Y": r"CASE WHEN regexp_full_match({x}, '\d{{1,2}} [A-Za-z]+ \d{{4}}') THEN try_strptime({x}, '%d %B %Y') END",
    "d b Y": r"CASE WHEN regexp_full_match({x}, '\d{{1,2}} [A-Za-z]{{3}} \d{{4}}') THEN try_strptime({x}, '%d %b %Y') END",
}


def iso_sql(x: str, token: str, formats: tuple[str, ...], token_formats: tuple[str, ...]) -> str:
    t = f"regexp_extract({x}, '{token}', 1)"
    tries = [ISO[f].format(x=x) for f in formats] + [ISO[f].format(x=t) for f in token_formats]
    return f"strftime(coalesce({', '.join(tries)}), '%Y-%m-%d')"


NORMALIZED_SQL = iso_sql("raw", dates.TOKEN, dates.NORMALIZER, dates.NORMALIZER)


@query(f"""WITH {X.STYLED_SQL}, n AS (SELECT doc_id, seq, {NORMALIZED_SQL} AS tran_date FROM styled)
SELECT doc_id, seq, tran_date, row_number() OVER (PARTITION BY doc_id ORDER BY tran_date NULLS LAST, seq) - 1 AS position FROM n""")
def q_normalize_sort(t: Tables) -> DataFrame:
    rows = X.styled_dates(t.orders).select("doc_id", "seq", F.col("raw").alias("tran_date"), F.lit(None).cast("string").alias("value_date"), *[F.lit(None).cast("string").alias(c) for c in ("withdrawal", "deposit", "balance")])
    return ledger.sorted_ledger(ledger.normalize(rows)).select("doc_id", "seq", "tran_date", F.col("position").cast("bigint").alias("position"))


METADATA_DATE_SQL = iso_sql("s", dates.TOKEN, dates.METADATA, dates.METADATA_TOKEN)


@query(f"WITH {X.STYLED_SQL}, s AS (SELECT seq, trim(regexp_replace(raw, 'st|nd|rd|th', '', 'g')) AS s FROM styled) SELECT seq, {METADATA_DATE_SQL} AS iso FROM s")
def q_metadata_dates(t: Tables) -> DataFrame:
    return X.styled_dates(t.orders).select("seq", dates.metadata_date(F.col("raw")).alias("iso"))


BLOCK_DATE_SQL = iso_sql("raw", dates.BLOCK_DATE, dates.NORMALIZER, dates.BLOCK_TOKEN)


@query(f"WITH {X.STYLED_SQL} SELECT seq, {BLOCK_DATE_SQL} AS block_iso, {NORMALIZED_SQL} AS validator_iso FROM styled")
def q_block_dates(t: Tables) -> DataFrame:
    r = F.col("raw")
    return X.styled_dates(t.orders).select("seq", dates.block_date(r).alias("block_iso"), dates.validator_date(r).alias("validator_iso"))


AMOUNT_RE = r"(\d{1,3}(?:[,.]\d{3})*(?:[.,]\d{2}))"


@query(rf"""WITH x AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL
  SELECT 'l' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR),
    'paid -' || format('{{:,.2f}}', l_extendedprice) || ' of ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) FROM lineitem
), a AS (SELECT id, regexp_extract_all(text, '{AMOUNT_RE}', 1) AS found, replace(regexp_extract(text, '(-?\d{{1,3}}(?:[,\.]\d{{3}})*(?:[.,]\d{{2}}))', 1), ',', '') AS first FROM x)
SELECT id, CAST(len(found) AS INT) AS n_amounts, array_to_string(found, ' ') AS amounts,
  CASE WHEN regexp_full_match(first, '[+-]?\d+(\.\d*)?') THEN CAST(CAST(first AS DOUBLE) AS DECIMAL(18,2)) END AS first_amount FROM a""")
def q_amount_extract(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    paid = F.concat(F.lit("paid -"), F.format_number("l_extendedprice", 2), F.lit(" of "), price.cast("string"))
    ids = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    x = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(t.lineitem.select(ids.alias("id"), paid.alias("text")))
    found = amounts.find_amounts(F.col("text"))
    return x.select("id", F.size(found).alias("n_amounts"), F.array_join(found, " ").alias("amounts"), amounts.first_amount(F.col("text")).cast("decimal(18,2)").alias("first_amount"))


BANK_SQL = "CASE " + " ".join(f"WHEN contains(upper(text), '{b}') THEN '{b}'" for b in metadata.BANKS) + " END"
S_PERIOD = iso_sql("p1", dates.TOKEN, dates.METADATA, dates.METADATA_TOKEN)
E_PERIOD = iso_sql("p2", dates.TOKEN, dates.METADATA, dates.METADATA_TOKEN)


@query(rf"""WITH {X.HEADERS_SQL}, p AS (
  SELECT doc_id, text, upper(text) AS up,
    trim(regexp_replace(regexp_extract(text, '(?i)STATEMENT\s+FROM\s+(.+?)\s+TO\s+(.+?)\n', 1), 'st|nd|rd|th', '', 'g')) AS p1,
    trim(regexp_replace(regexp_extract(text, '(?i)STATEMENT\s+FROM\s+(.+?)\s+TO\s+(.+?)\n', 2), 'st|nd|rd|th', '', 'g')) AS p2 FROM heads
)
SELECT doc_id,
  coalesce(nullif(regexp_extract(up, 'A/C\s*[: ]\s*([0-9Xx\*\-]{{4,20}})', 1), ''), nullif(regexp_extract(up, 'ACCOUNT\s*NO\.?\s*[: ]\s*([0-9Xx\*\-]{{4,20}})', 1), ''),
    nullif(regexp_extract(text, '(\d{{8,20}})', 1), '')) AS account_number,
  trim(regexp_replace(coalesce(nullif(regexp_extract(text, '(?i)(?:CUSTOMER NAME|NAME|ACCOUNT NAME)[:\s]*([A-Z][A-Z\s\.,&-]{{3,100}})', 1), ''),
    list_filter(string_split(text, chr(10)), lambda s: s = upper(s) AND s <> lower(s) AND length(s) BETWEEN 4 AND 79)[1]), '\s+', ' ', 'g')) AS account_name,
  {BANK_SQL} AS bank_name,
  nullif(regexp_extract(up, '([A-Z]{{4}}[0-9]{{7}})', 1), '') AS ifsc, nullif(regexp_extract(text, '\b(\d{{9}})\b', 1), '') AS micr,
  {S_PERIOD} AS period_start, {E_PERIOD} AS period_end,
  CAST(replace(regexp_extract(up, 'OPENING\s+BALANCE\s*[:\-]?\s*([0-9,]+\.?[0-9]{{0,2}})', 1), ',', '') AS DECIMAL(18,2)) AS opening_balance,
  CAST(replace(regexp_extract(up, 'CLOSING\s+BALANCE\s*[:\-]?\s*([0-9,]+\.?[0-9]{{0,2}})', 1), ',', '') AS DECIMAL(18,2)) AS closing_balance
FROM p""")
def q_metadata_fields(t: Tables) -> DataFrame:
    m = metadata.metadata_of(X.headers(t.customer))
    return m.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("opening_balance", "closing_balance")})


@query(f"""WITH {X.HEADERS_SQL}, m AS (SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 5 = 0 THEN 'SBI' ELSE {BANK_SQL} END AS bank_name FROM heads)
SELECT CASE WHEN lower(coalesce(bank_name, '')) IN ('uco bank', 'axis bank', 'state bank of india', 'sbi') THEN 'parser' ELSE 'model' END AS branch, count(*) AS n FROM m GROUP BY 1""")
def q_bank_routing(t: Tables) -> DataFrame:
    m = X.headers(t.customer).select("doc_id", F.when(F.col("doc_id").cast("bigint") % 5 == 0, F.lit("SBI")).otherwise(metadata.bank_name(F.col("text"))).alias("bank_name"))
    to_parser, to_model = tables.route_by_bank(m)
    both = to_parser.withColumn("branch", F.lit("parser")).unionByName(to_model.withColumn("branch", F.lit("model")))
    return both.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


RECORD_SQL = """
records AS (
  SELECT event_id AS seq, CASE event_id % 6
    WHEN 0 THEN MAP {'date': '2020-01-0' || CAST(1 + user_id % 9 AS VARCHAR), 'particulars': event_type, 'dr': '1,' || CAST(100 + user_id AS VARCHAR), 'bal': '5'}
    WHEN 1 THEN MAP {'txn_date': '2020-02-01', 'description': event_type, 'amount': CAST(user_id AS VARCHAR), 'type': 'Debit'}
    WHEN 2 THEN MAP {'tran_date': '', 'value_date': '2020-03-01', 'remarks': event_type, 'amount': CAST(user_id AS VARCHAR)}
    WHEN 3 THEN MAP {'tran_date': '2020-04-01', 'narration': event_type, 'withdrawal': '7', 'credit': '9', 'running_balance': '1,000.50'}
    WHEN 4 THEN MAP {'transaction_date': '2020-05-01', 'credit_amount': '12', 'balance': 'n/a'}
    ELSE MAP {'narration': '', 'remarks': event_type, 'deposit': 'x', 'cr': '3'} END AS rec
  FROM events
)"""


def _records(events: DataFrame) -> DataFrame:
    user, kind, k = F.col("user_id"), F.col("event_type"), F.col("event_id") % 6
    text = lambda c: c.cast("string")

    def made(**pairs) -> object:
        return F.create_map(*[x for key, v in pairs.items() for x in (F.lit(key), F.lit(v) if isinstance(v, str) else v)])

    rec = (
        F.when(k == 0, made(date=F.concat(F.lit("2020-01-0"), text(1 + user % 9)), particulars=kind, dr=F.concat(F.lit("1,"), text(100 + user)), bal="5"))
        .when(k == 1, made(txn_date="2020-02-01", description=kind, amount=text(user), type="Debit"))
        .when(k == 2, made(tran_date="", value_date="2020-03-01", remarks=kind, amount=text(user)))
        .when(k == 3, made(tran_date="2020-04-01", narration=kind, withdrawal="7", credit="9", running_balance="1,000.50"))
        .when(k == 4, made(transaction_date="2020-05-01", credit_amount="12", balance="n/a"))
        .otherwise(made(narration="", remarks=kind, deposit="x", cr="3"))
    )
    return events.select(F.col("event_id").alias("seq"), rec.alias("rec"))


def _first_sql(keys: tuple[str, ...], empty: bool) -> str:
    return "coalesce(" + ", ".join(f"nullif(rec['{k}'], '')" if empty else f"rec['{k}']" for k in keys) + ")"


def _number_sql(x: str) -> str:
    return f"TRY_CAST(replace(replace({x}, ',', ''), '₹', '') AS DOUBLE)"


@query(f"""WITH {RECORD_SQL}, c AS (
  SELECT seq, rec, {_first_sql(coerce.DATE_KEYS, True)} AS tran_date, {_first_sql(coerce.NARRATION_KEYS, True)} AS narration,
    {_number_sql(_first_sql(coerce.BALANCE_KEYS, False))} AS balance, {_number_sql("rec['withdrawal']")} AS w0, {_number_sql("rec['deposit']")} AS d0 FROM records
), d AS (
  SELECT *, CASE WHEN w0 IS NULL AND d0 IS NULL THEN {_number_sql(_first_sql(coerce.DEBIT_KEYS, True))} ELSE w0 END AS w1,
    CASE WHEN w0 IS NULL AND d0 IS NULL THEN {_number_sql(_first_sql(coerce.CREDIT_KEYS, True))} ELSE d0 END AS d1,
    lower(coalesce(nullif(rec['type'], ''), rec['txn_type'], '')) IN ('debit', 'dr', 'withdrawal') AS debit FROM c
)
SELECT seq, tran_date, tran_date AS value_date, narration,
  CASE WHEN w1 IS NULL AND d1 IS NULL AND debit THEN {_number_sql("rec['amount']")} ELSE w1 END AS withdrawal,
  CASE WHEN w1 IS NULL AND d1 IS NULL AND NOT debit THEN {_number_sql("rec['amount']")} ELSE d1 END AS deposit, balance FROM d""")
def q_coerce_aliases(t: Tables) -> DataFrame:
    return coerce.coerce_rows(_records(t.events))


@query(f"""WITH {X.HEADERS_SQL}, x AS (SELECT doc_id, {BANK_SQL} AS bank_name, nullif(regexp_extract(text, '\\b(\\d{{9}})\\b', 1), '') AS micr FROM heads),
m AS (SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 6 = 0 THEN '' WHEN CAST(doc_id AS BIGINT) % 6 = 1 THEN 'MODEL' END AS bank_name, CAST(NULL AS VARCHAR) AS micr
  FROM heads WHERE CAST(doc_id AS BIGINT) % 2 = 0 OR CAST(doc_id AS BIGINT) % 3 = 1)
SELECT x.doc_id, coalesce(m.bank_name, x.bank_name) AS bank_name, coalesce(m.micr, x.micr) AS micr FROM x LEFT JOIN m USING (doc_id)""")
def q_metadata_merge(t: Tables) -> DataFrame:
    heads, k = X.headers(t.customer), F.col("doc_id").cast("bigint")
    x = heads.select("doc_id", metadata.bank_name(F.col("text")).alias("bank_name"), metadata.micr(F.col("text")).alias("micr"))
    m = heads.where((k % 2 == 0) | (k % 3 == 1)).select("doc_id", F.when(k % 6 == 0, F.lit("")).when(k % 6 == 1, F.lit("MODEL")).alias("bank_name"), F.lit(None).cast("string").alias("micr"))
    return coerce.prefer(m, x, ("bank_name", "micr"))


@query("""WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS chunk_index, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END AS bank_name,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS ifsc FROM orders)
SELECT doc_id, arg_min(bank_name, chunk_index) FILTER (WHERE bank_name <> '') AS bank_name, arg_min(ifsc, chunk_index) FILTER (WHERE ifsc <> '') AS ifsc FROM c GROUP BY doc_id""")
def q_chunk_metadata_merge(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    c = t.orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_index"),
        F.when(k == 1, F.lit("")).when(k == 2, F.col("o_orderpriority")).alias("bank_name"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).alias("ifsc"),
    )
    return coerce.merge_chunks(c, ("bank_name", "ifsc"))


NARR_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce(narration, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
KEYED_SQL = X.COPIES_SQL + f""", keyed AS (
  SELECT *, {NARR_SQL} AS narr, CAST(coalesce(nullif(deposit, 0), nullif(withdrawal, 0), 0) AS DECIMAL(18,2)) AS amt,
    CASE WHEN balance IS NULL THEN 0 ELSE 3 END + CASE WHEN withdrawal IS NULL THEN 0 ELSE 2 END + CASE WHEN deposit IS NULL THEN 0 ELSE 2 END
      + CASE WHEN length(trim(coalesce(narration, ''))) > 10 THEN 1 ELSE 0 END AS score FROM copies
)"""


@query(f"""WITH {KEYED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tran_date, narr, amt, balance ORDER BY score DESC, seq) AS nth FROM keyed)
SELECT doc_id, seq, tran_date, balance FROM r WHERE nth = 1 OR tran_date IS NULL""")
def q_dedup_exact(t: Tables) -> DataFrame:
    return dedup.drop_exact(X.with_copies(t.orders)).select("doc_id", "seq", "tran_date", "balance")


@query(f"""WITH {KEYED_SQL}, k AS (SELECT * FROM keyed WHERE amt <> 0 AND tran_date IS NOT NULL)
SELECT a.doc_id, a.seq, b.seq AS other_seq, CAST(levenshtein(a.narr, b.narr) AS INT) AS distance FROM k a JOIN k b
  ON a.doc_id = b.doc_id AND a.tran_date = b.tran_date AND a.amt = b.amt AND a.seq < b.seq WHERE levenshtein(a.narr, b.narr) <= 0.1 * greatest(length(a.narr), length(b.narr))""")
def q_dedup_lev(t: Tables) -> DataFrame:
    return dedup.similar_pairs(X.with_copies(t.orders))


@query()
def q_dedup_fuzzy(t: Tables) -> DataFrame:
    return dedup.drop_fuzzy(X.with_copies(t.orders)).select("doc_id", "slot", "seq", "tran_date", "balance")


HASH_SQL = r"md5(concat_ws('|', coalesce(tran_date, ''), CAST(abs(amt) AS VARCHAR), trim(regexp_replace(regexp_replace(lower(coalesce(narration, '')), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))))"


@query(f"WITH {KEYED_SQL}, h AS (SELECT doc_id, seq, {HASH_SQL} AS key FROM keyed) SELECT doc_id, min(seq) AS seq, key FROM h GROUP BY doc_id, key")
def q_dedup_hash(t: Tables) -> DataFrame:
    return dedup.drop_by_hash(X.with_copies(t.orders)).select("doc_id", "seq", dedup.hash_key().alias("key"))


@query()
def q_dedup_three_passes(t: Tables) -> DataFrame:
    rows = X.with_copies(t.orders).withColumn("page_no", (F.col("seq") % 4).cast("int"))
    return dedup.three_passes(rows).select("doc_id", "seq", "tran_date")


@query(f"""WITH {KEYED_SQL}, a AS (SELECT doc_id, count(*) AS n FROM copies GROUP BY doc_id), h AS (SELECT doc_id, count(DISTINCT {HASH_SQL}) AS kept FROM keyed GROUP BY doc_id)
SELECT doc_id, 1 - CAST(kept AS DOUBLE) / n AS loss_rate, 1 - CAST(kept AS DOUBLE) / n > 0.2 AS suspicious FROM a JOIN h USING (doc_id)""")
def q_dedup_loss(t: Tables) -> DataFrame:
    rows = X.with_copies(t.orders)
    return dedup.loss_rates(rows, dedup.drop_by_hash(rows))


@query(f"""WITH {X.LEDGER_SQL}, b AS (SELECT doc_id, seq, coalesce(deposit, withdrawal) AS amount, balance FROM ledger WHERE balance IS NOT NULL),
k AS (SELECT *, last_value(CASE WHEN balance <> 0 THEN balance END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM b)
SELECT doc_id, seq, CASE WHEN known IS NULL OR balance > known THEN amount END AS deposit, CASE WHEN NOT (known IS NULL OR balance > known) THEN amount END AS withdrawal FROM k""")
def q_infer_sides(t: Tables) -> DataFrame:
    b = X.ledger(t.orders).where("balance is not null").select("doc_id", "seq", F.coalesce("deposit", "withdrawal").alias("amount"), "balance")
    return ledger.infer_sides(b).select("doc_id", "seq", "deposit", "withdrawal")


@query()
def q_block_parse(t: Tables) -> DataFrame:
    return blocks.parse_blocks(X.statement_lines(t.orders))


@query(f"""WITH {X.LEDGER_SQL}, o AS (SELECT *, last_value(nullif(abs(balance), 0) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY tran_date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM ledger)
SELECT doc_id, count(*) AS n, sum(coalesce(deposit, withdrawal)) AS total,
  sum(CASE WHEN known IS NULL OR coalesce(abs(balance), 0) > known THEN coalesce(deposit, withdrawal) ELSE 0 END) AS deposits FROM o GROUP BY doc_id""")
def q_block_parse_totals(t: Tables) -> DataFrame:
    """The rendered statements parsed back: the parser infers the sides from the balances, as the window does."""
    b = blocks.parse_blocks(X.statement_lines(t.orders))
    m = lambda c: amounts.money(F.col(c))
    return b.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(m("deposit"), m("withdrawal"))).alias("total"), F.sum(F.coalesce(m("deposit"), F.lit(0).cast("decimal(18,2)"))).alias("deposits")
    )


@query()
def q_responses(t: Tables) -> DataFrame:
    layout = X.statement_lines(t.orders)
    table = X.cells(t.lineitem).where(F.lit(False))
    return statements.parse(layout, table)


@query("""WITH h AS (SELECT o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
SELECT id, CAST(list_reduce(list_prepend(0, list_transform(string_split(h, ''), lambda d: strpos('0123456789abcdef', d) - 1)), lambda a, d: (a * 16 + d) % 100) AS INT) AS bucket FROM h""")
def q_canary(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), bucket_of_100(F.col("o_orderkey").cast("string")).alias("bucket"))
