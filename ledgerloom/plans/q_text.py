"""Queries on lines, tables, chunks and salvage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_salvage, text
from ..operators import chunking, lines, quality, tables
from . import fixtures as X
from .registry import Tables, query

LINES_SQL = r"""
parts AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\f\x0b\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'),
  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS text, generate_subscripts(list_filter(list_transform(
  regexp_split_to_array(text, '\r\n|[\n\r\f\x0b\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''), 1) - 1 AS pos FROM documents),
lines AS (SELECT doc_id, CAST(pos AS INT) AS pos, text FROM parts)"""
HIT_SQL = r"(regexp_matches(text, '\b\d{2}[-/]\d{2}[-/]\d{2,4}\b') OR regexp_matches(text, '\d{1,3}(?:[,.]\d{3})*(?:[.,]\d{2})'))"
NOISE_SQL = (
    r"(regexp_matches(text, '(?i)^(?:page\s*\d+\s*of\s*\d+|page\s*\d+|transaction(?:s)?|date|amount\s+subtracted|amount\s+added|opening\s+balance|closing\s+balance)$')"
    r" OR regexp_matches(text, '(?i)^\s*page\s*\d+') OR (length(text) <= 2 AND NOT regexp_matches(text, '[A-Za-z0-9]')))"
)


def _lines(t: Tables) -> DataFrame:
    return lines.explode_lines(t.documents)


@query(f"WITH {LINES_SQL} SELECT doc_id, pos, text FROM lines WHERE NOT {NOISE_SQL}")
def q_clean_lines(t: Tables) -> DataFrame:
    return lines.clean_lines(_lines(t))


@query(rf"""WITH {LINES_SQL}, k AS (SELECT *, regexp_matches(text, '\d') AS digit, max(CAST(regexp_matches(text, '\d') AS INT)) OVER (PARTITION BY doc_id) AS any_digit FROM lines),
u AS (SELECT doc_id, pos, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM k WHERE digit OR any_digit = 0)
SELECT doc_id, pos, text FROM u WHERE upto <= 500""")
def q_relevant_prefix(t: Tables) -> DataFrame:
    return lines.relevant_lines(_lines(t), 500)


HEADER_SQL = (
    r"regexp_matches(lower(text), '(?i)^(page\b|date\b|particulars\b|instrument\b|withdrawals\b|deposits\b|balance\b|client code\b|branch code\b|ifsc code\b"
    r"|branch name\b|address\b|phone\b|statement for a/c|page \d+ of|page\s*\d+)')"
)


@query(rf"""WITH {LINES_SQL}, x AS (SELECT 'd' AS kind, doc_id AS id, pos, text FROM lines UNION ALL SELECT 'h', c_custkey, 0, CASE c_custkey % 5 WHEN 0 THEN 'Page 3 of 9'
  WHEN 1 THEN 'DATE ' || c_name WHEN 2 THEN 'Dated ' || c_name WHEN 3 THEN 'Statement for A/c' ELSE 'Balance' END FROM customer)
SELECT kind, id, pos, text, {HEADER_SQL} AS is_header, regexp_matches(text, '(?i)^page\s+\d+\s+of\s+\d+') AS is_page_of FROM x WHERE kind = 'h' OR NOT {HEADER_SQL}""")
def q_header_filter(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    made = F.when(k == 0, F.lit("Page 3 of 9")).when(k == 1, F.concat(F.lit("DATE "), "c_name")).when(k == 2, F.concat(F.lit("Dated "), "c_name")).when(k == 3, F.lit("Statement for A/c")).otherwise("Balance")
    h = t.customer.select(F.lit("h").alias("kind"), F.col("c_custkey").alias("id"), F.lit(0).alias("pos"), made.alias("text"))
    x = _lines(t).select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "pos", "text").unionByName(h)
    x = x.withColumns({"is_header": text.is_header(F.col("text")), "is_page_of": F.col("text").rlike(text.PAGE_OF)})
    return x.where("kind = 'h' or not is_header")


@query("""WITH x AS (SELECT doc_id, 'layout' AS source, text FROM documents UNION ALL SELECT conv_id, CASE WHEN role = 'user' THEN 'table' ELSE 'ocr' END, text FROM conversations),
c AS (SELECT doc_id, CAST(coalesce(sum(length(text)) FILTER (WHERE source = 'table'), 0) AS BIGINT) AS table_chars, CAST(coalesce(sum(length(text)) FILTER (WHERE source = 'ocr'), 0) AS BIGINT) AS ocr_chars,
  CAST(coalesce(sum(length(text)) FILTER (WHERE source = 'layout'), 0) AS BIGINT) AS layout_chars FROM x GROUP BY doc_id), d AS (SELECT *, table_chars + ocr_chars + layout_chars AS total_chars FROM c)
SELECT *, CASE WHEN total_chars = 0 THEN 0 ELSE greatest(1, total_chars // 4) END AS tokens, CAST(greatest(1, least(10, ceil(total_chars / 15000.0))) AS INT) AS chunks, total_chars > 25000 AS over_payload FROM d""")
def q_line_sources_chars(t: Tables) -> DataFrame:
    role = F.when(F.col("role") == "user", F.lit("table")).otherwise("ocr")
    x = t.documents.select("doc_id", F.lit("layout").alias("source"), "text").unionByName(t.conversations.select(F.col("conv_id").alias("doc_id"), role.alias("source"), "text"))
    total = F.col("total_chars")
    return chunking.char_totals(x).withColumns({"tokens": text.estimate_tokens(total), "chunks": chunking.chunk_count(total), "over_payload": tables.over_payload(total, F.lit(False))})


RIGHT_SQL = r"CAST(len(cells) - list_position(list_reverse(list_transform(cells, lambda c: regexp_matches(coalesce(c, ''), '\d[\d,]*\.?\d{0,2}'))), true) AS INT)"


@query(f"""WITH {X.CELLS_SQL}, p AS (SELECT doc_id, {RIGHT_SQL} AS place FROM cells), q AS (SELECT doc_id, CASE WHEN place >= 4 THEN NULL ELSE place END AS place FROM p),
c AS (SELECT doc_id, place, count(*) AS n FROM q GROUP BY ALL), s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(coalesce(sum(n) FILTER (WHERE place IS NOT NULL), 0) AS BIGINT) AS n_numeric, coalesce(max(n) FILTER (WHERE place IS NOT NULL), 0) AS mode_count FROM c GROUP BY doc_id)
SELECT *, n_numeric > 0 AND mode_count >= greatest(2, floor(n_numeric * 0.5)) AND n_rows >= 3 AS usable FROM s""")
def q_table_usable(t: Tables) -> DataFrame:
    return tables.table_usability(X.cells(t.lineitem))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS has_layout, o_orderkey % 3 = 0 AS has_table, o_orderkey % 5 = 0 AS usable, o_orderkey % 7 = 0 AS is_docx FROM orders)
SELECT id, (NOT has_layout AND NOT has_table) OR (has_table AND NOT usable) AS ocr, NOT (is_docx OR usable) AS ocr_streamed,
  (NOT has_layout AND NOT has_table) OR (has_table AND NOT usable) OR id % 11 < 3 AS ocr_or_forced FROM f""")
def q_ocr_gate(t: Tables) -> DataFrame:
    f = lambda n: F.col("o_orderkey") % n == 0
    flag = F.get(F.array(*map(F.lit, ("1", "True", "YES", "0", "no", "", "2"))), (F.col("o_orderkey") % 11).cast("int"))  # null from the seventh on
    return t.orders.select(
        F.col("o_orderkey").alias("id"), tables.needs_ocr(f(2), f(3), f(5)).alias("ocr"), tables.needs_ocr_streamed(f(7), f(5)).alias("ocr_streamed"),
        tables.needs_ocr(f(2), f(3), f(5), tables.forced_ocr(flag)).alias("ocr_or_forced"),
    )


@query(f"""WITH {X.CELLS_SQL}
SELECT doc_id, row_no, trim(array_to_string(list_transform(cells, lambda c: trim(coalesce(c, ''))), ' | ')) AS piped,
  array_to_string(list_transform(list_filter(cells, lambda c: c IS NOT NULL), lambda c: trim(c)), ' | ') AS piped_filled,
  trim(array_to_string(list_transform(cells, lambda c: trim(coalesce(c, ''))), ' ')) AS spaced,
  array_to_string(list_transform(list_filter(cells, lambda c: c IS NOT NULL), lambda c: trim(c)), ' ') AS spaced_filled FROM cells""")
def q_row_texts(t: Tables) -> DataFrame:
    return tables.row_texts(X.cells(t.lineitem)).drop("cells")


@query(f"""WITH {LINES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM lines)
SELECT doc_id, pos AS row_no, CASE WHEN nth <= CASE WHEN n > 30 THEN 15 ELSE 10 END THEN 'head' ELSE 'tail' END AS part FROM n
WHERE nth <= CASE WHEN n > 30 THEN 15 ELSE 10 END OR (n > 30 AND nth > n - 10)""")
def q_head_tail(t: Tables) -> DataFrame:
    return tables.head_and_tail(_lines(t).select("doc_id", F.col("pos").alias("row_no"))).select("doc_id", "row_no", "part")


@query(f"""WITH {X.CELLS_SQL}, h AS (SELECT doc_id, row_no, CASE WHEN row_no = 1 AND CAST(doc_id AS BIGINT) % 3 = 0 THEN ['x', 'Balance', 'y'] ELSE cells END AS cells FROM cells),
b AS (SELECT doc_id, 2 AS place FROM h WHERE row_no < 3 AND list_contains(list_transform(cells, lambda c: coalesce(contains(upper(c), 'BALANCE'), false)), true)),
a AS (SELECT h.doc_id, row_no, CASE WHEN place IS NOT NULL THEN cells[2] END AS own, CASE WHEN len(cells) > 1 THEN cells[-1] END AS last FROM h LEFT JOIN b USING (doc_id)),
v AS (SELECT doc_id, row_no, TRY_CAST(replace(regexp_extract(own, '(-?\\d{{1,3}}(?:[,\\.]\\d{{3}})*(?:[.,]\\d{{2}}))', 1), ',', '') AS DOUBLE) AS own,
  TRY_CAST(replace(regexp_extract(last, '(-?\\d{{1,3}}(?:[,\\.]\\d{{3}})*(?:[.,]\\d{{2}}))', 1), ',', '') AS DOUBLE) AS last FROM a)
SELECT doc_id, CASE WHEN count(own) > 0 THEN arg_min(own, row_no) ELSE arg_min(last, row_no) END AS opening_balance,
  CASE WHEN count(own) > 0 THEN arg_max(own, row_no) ELSE arg_max(last, row_no) END AS closing_balance FROM v GROUP BY doc_id""")
def q_table_balances(t: Tables) -> DataFrame:
    from ..functions.metadata import balances_of_rows

    head = (F.col("row_no") == 1) & (F.col("doc_id").cast("bigint") % 3 == 0)
    return balances_of_rows(X.cells(t.lineitem).withColumn("cells", F.when(head, F.array(F.lit("x"), F.lit("Balance"), F.lit("y"))).otherwise(F.col("cells"))))


LAYOUTS_SQL = "layouts AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS layout FROM documents)"
SHOWN_SQL = "shown AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 4 = 0 THEN text || ' #' ELSE text END AS text FROM lines)"


def _layouts_and_shown(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents
    layouts = d.select("doc_id", F.array_join(text.lines(F.col("text")), "\n").alias("layout"))
    changed = F.when((F.col("doc_id") + F.col("pos")) % 4 == 0, F.concat("text", F.lit(" #"))).otherwise(F.col("text"))
    return layouts, lines.explode_lines(d).withColumn("text", changed)


@query(f"""WITH {LINES_SQL}, {LAYOUTS_SQL}, {SHOWN_SQL}
SELECT l.doc_id, coalesce(avg(CASE WHEN contains(layout, text) THEN 1.0 ELSE 0 END) FILTER (WHERE length(text) > 3) >= 0.8, false) AS table_duplicate,
  coalesce(avg(CASE WHEN contains(layout, text) THEN 1.0 ELSE 0 END) FILTER (WHERE length(text) > 2) >= 0.6, true) AS ocr_duplicate FROM layouts l LEFT JOIN shown s USING (doc_id) GROUP BY l.doc_id""")
def q_dup_ratio(t: Tables) -> DataFrame:
    layouts, shown = _layouts_and_shown(t)
    a = lines.table_repeats_layout(shown, layouts).withColumnRenamed("duplicate", "table_duplicate")
    return a.join(lines.ocr_repeats_layout(shown, layouts).withColumnRenamed("duplicate", "ocr_duplicate"), "doc_id")


@query(f"""WITH {LINES_SQL}, {LAYOUTS_SQL}, {SHOWN_SQL}, f AS (SELECT l.doc_id, coalesce(avg(CASE WHEN contains(layout, text) THEN 1.0 ELSE 0 END) FILTER (WHERE length(text) > 2) >= 0.6, true) AS dup
  FROM layouts l LEFT JOIN shown s USING (doc_id) GROUP BY l.doc_id)
SELECT s.doc_id, s.pos, s.text FROM shown s JOIN layouts USING (doc_id) JOIN f USING (doc_id) WHERE NOT (dup AND contains(layout, s.text))""")
def q_unique_ocr(t: Tables) -> DataFrame:
    layouts, shown = _layouts_and_shown(t)
    return lines.unique_ocr_lines(shown, layouts)


@query(f"""WITH {LINES_SQL}, s AS (SELECT d.source AS doc_id, l.doc_id AS page_no, pos, l.text FROM lines l JOIN documents d USING (doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS nth FROM s), p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM s GROUP BY doc_id),
c AS (SELECT doc_id, text, count(DISTINCT page_no) AS n FROM t WHERE nth <= 20 GROUP BY doc_id, text)
SELECT doc_id, text FROM c JOIN p USING (doc_id) WHERE n / pages >= 0.04 AND length(text) > 3""")
def q_repeated_lines(t: Tables) -> DataFrame:
    d = t.documents
    pages = lines.explode_lines(d).join(d.select("doc_id", "source"), "doc_id").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "pos", "text")
    return lines.repeated_lines(pages, share=0.04)


@query(f"""WITH {LINES_SQL}, p AS (SELECT *, {HIT_SQL} AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM lines),
a AS (SELECT *, r - max(CASE WHEN hit THEN r END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS after, lead(hit) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM p)
SELECT doc_id, pos, text, hit AS is_match FROM a WHERE hit OR (length(text) > 3 AND after BETWEEN 1 AND 3) OR (length(text) > 3 AND coalesce(nxt, false) AND NOT regexp_matches(text, '(?i)^page\\s+\\d+'))""")
def q_context_window(t: Tables) -> DataFrame:
    return lines.with_context(_lines(t))


@query(f"""WITH {LINES_SQL}, b AS (SELECT doc_id, pos, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines)
SELECT doc_id, pos, CAST(floor(before / 1000) AS INT) AS chunk_index FROM b""")
def q_even_chunks(t: Tables) -> DataFrame:
    return chunking.even_chunks(_lines(t), 1000).select("doc_id", "pos", "chunk_index")


@query()
def q_chunks(t: Tables) -> DataFrame:
    rows = _lines(t).withColumn("source", F.when(F.col("pos") % 3 == 0, F.lit("table")).when(F.col("pos") % 3 == 1, F.lit("ocr")).otherwise("layout"))
    return chunking.split_chunks(rows).drop("text")


@query(f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines GROUP BY doc_id""")
def q_chunk_coverage(t: Tables) -> DataFrame:
    """Lines that are not overlap cover each document once."""
    rows = _lines(t).withColumn("source", F.when(F.col("pos") % 3 == 0, F.lit("table")).when(F.col("pos") % 3 == 1, F.lit("ocr")).otherwise("layout"))
    own = chunking.split_chunks(rows).where(~F.col("is_overlap"))
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query(f"WITH {LINES_SQL}, n AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM lines) SELECT doc_id, pos, CAST((nth - 1) // 7 AS INT) AS batch FROM n")
def q_batches(t: Tables) -> DataFrame:
    return chunking.batches(_lines(t), 7).select("doc_id", "pos", "batch")


WRAPPED_SQL = """
wrapped AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN '<think>{ no }</think> ' || props
  WHEN 3 THEN 'I found [' || props || ', ' || props || '] there' WHEN 4 THEN 'nothing here' WHEN 5 THEN 'row: [' || props || '] end' ELSE 'list' || chr(10) || '[1, [2, ' || CAST(event_id AS VARCHAR) || ']] and ]' END AS raw FROM events)"""


def _wrapped(events: DataFrame) -> DataFrame:
    k, p = F.col("event_id") % 7, F.col("props")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    raw = (
        F.when(k == 0, p).when(k == 1, c("Sure:\n```json\n", p, "\n```")).when(k == 2, c("<think>{ no }</think> ", p)).when(k == 3, c("I found [", p, ", ", p, "] there"))
        .when(k == 4, F.lit("nothing here")).when(k == 5, c("row: [", p, "] end")).otherwise(c("list\n[1, [2, ", F.col("event_id").cast("string"), "]] and ]"))
    )
    return events.select("event_id", raw.alias("raw"))


@query(f"""WITH {WRAPPED_SQL} SELECT event_id, CASE event_id % 7 WHEN 4 THEN NULL WHEN 3 THEN '[' || props || ', ' || props || ']' WHEN 6 THEN '[1, [2, ' || CAST(event_id AS VARCHAR) || ']]' ELSE props END AS json
FROM wrapped JOIN events USING (event_id)""")
def q_json_salvage(t: Tables) -> DataFrame:
    return _wrapped(t.events).select("event_id", json_salvage.salvage_json(F.col("raw")).alias("json"))


@query(rf"WITH {WRAPPED_SQL} SELECT event_id, regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM wrapped")
def q_think_tags(t: Tables) -> DataFrame:
    return _wrapped(t.events).select("event_id", json_salvage.without_thinking(F.col("raw")).alias("plain"))


@query("""WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"error": {"message": "Please try again in ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || 's."}}'
  WHEN 1 THEN '{"error": {"message": "Try again in ' || CAST(event_id AS VARCHAR) || 'ms"}}' WHEN 2 THEN '{"error": {"message": "no"}}' ELSE 'not json' END AS body FROM events)
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN CAST(regexp_extract(body, 'in ([0-9.]+)s', 1) AS DOUBLE) WHEN 1 THEN event_id / 1000 ELSE 0 END AS DECIMAL(18,3)) AS seconds FROM m""")
def q_retry_after(t: Tables) -> DataFrame:
    k, c = F.col("event_id") % 4, lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    body = (
        F.when(k == 0, c('{"error": {"message": "Please try again in ', F.col("value").cast("decimal(18,2)").cast("string"), 's."}}'))
        .when(k == 1, c('{"error": {"message": "Try again in ', F.col("event_id").cast("string"), 'ms"}}')).when(k == 2, F.lit('{"error": {"message": "no"}}')).otherwise("not json")
    )
    return t.events.select("event_id", json_salvage.retry_after_seconds(body).cast("decimal(18,3)").alias("seconds"))


def _sum_sql(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"len(regexp_extract_all(body, '{p}'))" for p in patterns)


def _points_sql(x: str, scale: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN {points}" for least, points in scale) + " ELSE 0 END"


@query(f"""WITH b AS (SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN repeat(' 01-05-2020 1,234.50', CAST(doc_id % 25 AS INT)) ELSE '' END AS body, CAST(doc_id % 60 AS INT) AS n_rows,
  CAST(1 + doc_id % 4 AS INT) AS pages FROM documents), n AS (SELECT *, {_sum_sql(quality.DATE_PATTERNS)} AS dates, {_sum_sql(quality.AMOUNT_PATTERNS)} AS amounts, CAST(n_rows * 2 AS DOUBLE) / (pages * 40) AS fill FROM b),
s AS (SELECT *, least(100, least(30, {_points_sql('n_rows', quality.ROW_POINTS)} + CASE WHEN n_rows > 0 AND doc_id % 2 = 0 THEN 5 ELSE 0 END) + {_points_sql('fill', quality.LAYOUT_POINTS)}
  + {_points_sql('dates', quality.DATE_POINTS)} + {_points_sql('amounts', quality.AMOUNT_POINTS)}) AS score FROM n)
SELECT doc_id, CAST(score AS INT) AS score, CAST(dates AS INT) AS dates, CAST(amounts AS INT) AS amounts, score >= 70 AND NOT (dates < 5 AND amounts < 5) AS skip_ocr,
  NOT (n_rows < greatest(5, pages * 8) AND score >= 70 AND NOT (dates < 5 AND amounts < 5)) AS complete FROM s""")
def q_quality_score(t: Tables) -> DataFrame:
    d, k = t.documents, F.col("doc_id")
    extra = F.when(k % 3 == 0, F.repeat(F.lit(" 01-05-2020 1,234.50"), (k % 25).cast("int"))).otherwise("")
    rows, pages = (k % 60).cast("int"), (1 + k % 4).cast("int")
    q = quality.quality(F.concat("text", F.lit("\n"), extra), rows * 2, rows, k % 2 == 0, pages)
    out = d.select("doc_id", q.alias("q"), quality.complete_enough(rows, F.lit(True), pages).alias("_full"))
    return out.select("doc_id", "q.score", "q.dates", "q.amounts", "q.skip_ocr", (F.col("_full") | ~F.col("q.skip_ocr")).alias("complete"))


@query("""WITH c AS (SELECT doc_id, length(text) * 40 AS chars, CAST(1 + doc_id % 30 AS INT) AS pages FROM documents), s AS (SELECT *, greatest(1, least(ceil(pages / 5.0), ceil(chars / 18000.0), 10)) AS n FROM c)
SELECT doc_id, CASE WHEN chars > 60000 THEN 'chunked' ELSE 'single_shot' END AS strategy, CAST(CASE WHEN chars > 60000 THEN n ELSE 1 END AS INT) AS chunk_count,
  CAST(CASE WHEN chars > 60000 THEN ceil(pages / n) ELSE pages END AS INT) AS pages_per_chunk FROM s""")
def q_chunk_strategy(t: Tables) -> DataFrame:
    s = chunking.strategy(F.length("text") * 40, (1 + F.col("doc_id") % 30).cast("int"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query("""WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_no, CAST(1 + o_custkey % 4 AS INT) AS k FROM orders),
c AS (SELECT doc_id, page_no, CAST(floor(page_no / k) AS INT) AS chunk_id, k FROM p)
SELECT doc_id, page_no, chunk_id, false AS is_overlap FROM c UNION ALL
SELECT a.doc_id, a.page_no, b.chunk_id, true FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1 AND b.chunk_id = a.chunk_id + 1""")
def q_page_chunks(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    pages = t.orders.select(F.col("o_custkey").alias("doc_id"), nth.cast("bigint").alias("page_no"), (1 + F.col("o_custkey") % 4).cast("int").alias("pages_per_chunk"))
    return chunking.page_chunks(pages).select("doc_id", "page_no", "chunk_id", "is_overlap")


@query()
def q_payloads(t: Tables) -> DataFrame:
    rows = X.statement_lines(t.orders)
    half = rows.where("pos % 8 < 4")
    return lines.payloads(rows, half, half.withColumn("text", F.concat("text", F.lit("."))))


TRUNCATE_SQL = rf"""{LINES_SQL}, s AS (SELECT *, CASE pos % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'ocr' ELSE 'layout' END AS source, regexp_matches(text, '\d') AS digit FROM lines),
c AS (SELECT * FROM (SELECT *, max(CAST(digit AS INT)) OVER (PARTITION BY doc_id, source) AS any_digit FROM s) WHERE source = 'table' OR digit OR any_digit = 0),
u AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY doc_id, source ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM c),
t AS (SELECT doc_id, source, pos, text, upto FROM u WHERE source = 'table' AND upto <= 1000),
l AS (SELECT u.doc_id, source, pos, text, upto FROM u LEFT JOIN (SELECT doc_id, max(upto) AS used FROM t GROUP BY doc_id) USING (doc_id) WHERE source = 'layout' AND upto <= 1000 - coalesce(used, 0)),
o AS (SELECT u.doc_id, source, pos, text, upto FROM u LEFT JOIN (SELECT doc_id, sum(length(text)) AS used FROM (FROM t UNION ALL FROM l) GROUP BY doc_id) USING (doc_id)
  WHERE source = 'ocr' AND upto <= 1000 - coalesce(used, 0)),
kept AS (FROM t UNION ALL FROM l UNION ALL FROM o)"""


def _three_sources(t: Tables) -> DataFrame:
    return _lines(t).withColumn("source", F.when(F.col("pos") % 3 == 0, F.lit("table")).when(F.col("pos") % 3 == 1, F.lit("ocr")).otherwise("layout"))


@query(f"WITH {TRUNCATE_SQL} SELECT doc_id, pos, text, source FROM kept")
def q_truncate(t: Tables) -> DataFrame:
    return lines.truncate_by_priority(_three_sources(t), 1000)


@query(f"""WITH {TRUNCATE_SQL}, k AS (SELECT doc_id, source, count(*) AS n FROM kept GROUP BY ALL), h AS (SELECT doc_id, source, count(*) AS had FROM s GROUP BY ALL)
SELECT doc_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_kept, max(CAST(coalesce(n, 0) < had AS INT)) = 1 AS truncated FROM h LEFT JOIN k USING (doc_id, source) GROUP BY doc_id""")
def q_truncated(t: Tables) -> DataFrame:
    return lines.truncated_documents(_three_sources(t), 1000)


@query(rf"""WITH {LINES_SQL}, p AS (SELECT *, pos // 25 AS page_no FROM lines), top AS (SELECT DISTINCT doc_id, page_no, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS nth FROM p) WHERE nth <= 20),
r AS (SELECT doc_id, text FROM top JOIN (SELECT doc_id, count(DISTINCT page_no) AS pages FROM p GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, text, pages HAVING count(*) / pages >= {lines.REPEATED_SHARE} AND length(text) > 3)
SELECT doc_id, pos, text FROM p ANTI JOIN r USING (doc_id, text) WHERE NOT regexp_matches(text, '(?i)^page\s+\d+\s+of\s+\d+')""")
def q_without_repeated(t: Tables) -> DataFrame:
    """The lines that stay when those repeated on most pages go; 25 lines are a page."""
    return lines.without_repeated(_lines(t).withColumn("page_no", F.floor(F.col("pos") / 25).cast("int"))).select("doc_id", "pos", "text")


@query(r"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents),
l AS (SELECT doc_id, block_no, 0 AS line_no, text || ' ' || CASE WHEN doc_id % 2 = 0 THEN '  x ' ELSE '' END AS raw FROM b WHERE block_no % 5 <> 4 UNION ALL SELECT doc_id, block_no, 1, ' ' || chr(9) FROM b WHERE block_no % 5 <> 4)
SELECT doc_id, 0 AS page_no, CAST(block_no AS INT) AS block_no, line_no, clean AS text FROM (SELECT *, regexp_replace(regexp_replace(replace(raw, chr(9), ' '), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM l) WHERE clean <> ''""")
def q_flatten_layout(t: Tables) -> DataFrame:
    """A line of a text as a block: each fifth block has no lines; a second span is missing in odd documents; a second line is blank."""
    span = lambda s: F.struct(s.alias("text"))
    line = lambda *spans: F.struct(F.array(*spans).alias("spans"))
    second = F.when(F.col("doc_id") % 2 == 0, F.lit("  x "))
    blank = F.lit(None).cast("array<struct<spans:array<struct<text:string>>>>")
    blocks = F.transform(F.split("text", "\n"), lambda s, i: F.struct(F.when(i % 5 == 4, blank).otherwise(F.array(line(span(s), span(second)), line(span(F.lit("")), span(F.lit("\t"))))).alias("lines")))
    return lines.flatten_layout(t.documents.select("doc_id", F.array(blocks).alias("pages")))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 400 WHEN strlen(html) * 1000 > 26214400 THEN 413 WHEN strlen(html) < 1024 THEN 400 WHEN page_id % 4 = 0 AND page_id % 8 = 0 THEN 400
  WHEN page_id % 4 = 0 AND page_id % 80 > 50 THEN 413 END AS error_code FROM pages""")
def q_upload_checks(t: Tables) -> DataFrame:
    k = F.col("page_id")
    name = F.when(k % 4 == 3, F.lit("a.TXT")).when(k % 4 == 0, F.lit("a.PDF")).otherwise("a.docx")
    size = F.octet_length("html")
    size = F.when(size * 1000 > 26214400, size * 1000).otherwise(size)
    return t.pages.select("page_id", tables.upload_error(name, size, k % 8 == 0, (k % 80).cast("int")).alias("error_code"))


@query("""WITH a AS (SELECT o_custkey AS doc_id, o_orderkey AS seq FROM orders WHERE o_orderkey % 8 < 2), b AS (SELECT o_custkey AS doc_id, o_orderkey AS seq FROM orders WHERE o_orderkey % 8 >= 2)
SELECT doc_id, seq FROM a UNION ALL SELECT doc_id, seq FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def q_ocr_retry(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"))
    first, retry = rows.where("seq % 8 < 2"), rows.where("seq % 8 >= 2")
    return tables.keep_retry(first, retry.join(tables.retry_documents(retry.select("doc_id").distinct(), first), "doc_id", "left_semi"))


@query(r"""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'to 7-' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'POS dr ' || CAST(o_orderkey AS VARCHAR)
  WHEN 2 THEN 'ADDRESS OF HYDRA' WHEN 3 THEN 'salary DR. ' || CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS VARCHAR) END AS text FROM orders)
SELECT o_orderkey, coalesce(regexp_matches(text, '(?i)\bDR\b') OR contains(text, '-'), false) AS withdrawal, regexp_matches(text, '[0-9]{1,3}([,.][0-9]{3})*[.,][0-9]{2}') AS amount_in_it FROM n""")
def q_single_amount_sides(t: Tables) -> DataFrame:
    """The side of a booking with one amount, by its narration: a hyphen, the word DR in any case, DR inside words, DR and an amount, none."""
    key = F.col("o_orderkey")
    number = key.cast("string")
    price = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    narration = F.when(key % 5 == 0, F.concat(F.lit("to 7-"), number)).when(key % 5 == 1, F.concat(F.lit("POS dr "), number))
    narration = narration.when(key % 5 == 2, F.lit("ADDRESS OF HYDRA")).when(key % 5 == 3, F.concat(F.lit("salary DR. "), price))
    return t.orders.select("o_orderkey", text.is_withdrawal_narration(narration).alias("withdrawal"), text.has_amount(narration).alias("amount_in_it"))
