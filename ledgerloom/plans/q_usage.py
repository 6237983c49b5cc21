"""Queries on token usage, request metrics and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, usage
from ..streaming import jobs, rates
from . import fixtures as X
from .registry import Tables, query

NOW = "2024-01-20 12:30:00"


def now():
    return F.lit(NOW).cast("timestamp")

ROLLUP_SQL = f"""WITH {X.USAGE_SQL}, r AS (
  SELECT 'day' AS period, strftime(ts, '%Y-%m-%d') AS key, tokens FROM usage UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), tokens FROM usage
  UNION ALL SELECT 'hour', strftime(ts, '%Y-%m-%d-%H'), tokens FROM usage)
SELECT period, key, CAST(sum(tokens) AS BIGINT) AS tokens FROM r"""


@query(ROLLUP_SQL + " GROUP BY period, key")
def q_token_rollup(t: Tables) -> DataFrame:
    return usage.rollup(X.usage(t.events))


@query(ROLLUP_SQL + " WHERE key >= CASE period WHEN 'day' THEN '2024-01-15' WHEN 'month' THEN '2024-01' ELSE '2024-01-15-12' END GROUP BY period, key")
def q_retention(t: Tables) -> DataFrame:
    return usage.retained(usage.rollup(X.usage(t.events)), F.lit("2024-02-15 12:30:00").cast("timestamp"))


@query(f"""WITH {X.USAGE_SQL}, u AS (SELECT CAST(coalesce(sum(tokens) FILTER (WHERE strftime(ts, '%Y-%m-%d') = '2024-01-20'), 0) AS BIGINT) AS tokens_day,
  CAST(coalesce(sum(tokens) FILTER (WHERE strftime(ts, '%Y-%m') = '2024-01'), 0) AS BIGINT) AS tokens_month,
  CAST(coalesce(sum(tokens) FILTER (WHERE strftime(ts, '%Y-%m-%d-%H') = '2024-01-20-12'), 0) AS BIGINT) AS tokens_hour FROM usage),
l AS (SELECT *, CAST(1800000 AS BIGINT) AS hourly_limit, CAST(greatest(0, 1800000 - tokens_hour) AS BIGINT) AS remaining_hour, CAST(greatest(0, 14400000 - tokens_month) AS BIGINT) AS remaining_month FROM u)
SELECT *, remaining_hour >= 3000 AND remaining_month >= 3000 AS eligible, CAST(least(remaining_hour // 3000, remaining_month // 3000) AS BIGINT) AS calls_left,
  CASE WHEN tokens_month / 14400000 * 100 >= 90 THEN 'month: quota nearly exhausted' WHEN tokens_month / 14400000 * 100 >= 70 THEN 'month: monitor usage closely' ELSE '' END AS warnings FROM l""")
def q_usage_stats(t: Tables) -> DataFrame:
    s = usage.statistics(usage.usage_at(X.usage(t.events), now()))
    return s.withColumn("warnings", F.array_join("warnings", "; "))


@query(f"""WITH {X.USAGE_SQL} SELECT event_id, CAST(sum(tokens) OVER (PARTITION BY api_key_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999' SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS window_tokens,
  min(ts) OVER (PARTITION BY api_key_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999' SECOND PRECEDING AND CURRENT ROW) AS earliest FROM usage""")
def q_sliding_tpm(t: Tables) -> DataFrame:
    return usage.earliest_in_window(usage.sliding_tokens(X.usage(t.events))).select("event_id", "window_tokens", "earliest")


@query(f"""WITH {X.USAGE_SQL}, k AS (SELECT api_key_id, CAST(sum(tokens) AS BIGINT) AS used, CAST(CASE WHEN CAST(api_key_id AS BIGINT) % 5 = 0 THEN 0 ELSE 2000 END AS BIGINT) AS tpm_limit FROM usage GROUP BY api_key_id),
f AS (SELECT *, tpm_limit = 0 OR used + 500 <= tpm_limit AS fits FROM k) SELECT api_key_id, used, tpm_limit, tpm_limit > 0 AND 500 > tpm_limit AS too_large FROM f WHERE fits OR NOT (SELECT bool_or(fits) FROM f)""")
def q_keys_with_capacity(t: Tables) -> DataFrame:
    k = X.usage(t.events).groupBy("api_key_id").agg(F.sum("tokens").alias("used"))
    k = k.withColumn("tpm_limit", F.when(F.col("api_key_id").cast("bigint") % 5 == 0, 0).otherwise(2000).cast("bigint"))
    return usage.keys_with_capacity(k, 500).withColumn("too_large", usage.too_large(F.lit(500), F.col("tpm_limit")))


@query(f"""WITH {X.USAGE_SQL}, u AS (SELECT api_key_id, ts, sum(tokens) AS tokens FROM usage GROUP BY ALL),
w AS (SELECT i.event_id, e.ts AS used_at, i.tokens, sum(e.tokens) OVER (PARTITION BY i.event_id ORDER BY e.ts DESC) AS since, e.tokens AS own
  FROM usage i JOIN u e ON e.api_key_id = i.api_key_id AND e.ts < i.ts AND epoch_us(e.ts) > epoch_us(i.ts) - 3600000000),
f AS (SELECT event_id, max(since) AS recent, min(used_at) FILTER (WHERE since - own + tokens <= 100) AS frees FROM w GROUP BY event_id)
SELECT event_id, CASE WHEN tokens <= 0 OR coalesce(recent, 0) + tokens <= 100 THEN ts WHEN tokens <= 100 THEN frees + INTERVAL 3600050 MILLISECONDS END AS earliest_start FROM usage LEFT JOIN f USING (event_id)""")
def q_earliest_start(t: Tables) -> DataFrame:
    """With an hour as the window: the events are too far apart for a minute to fill."""
    return usage.earliest_start(X.usage(t.events), 100, seconds=3600).select("event_id", "earliest_start")


@query(f"""WITH {X.USAGE_SQL}, e AS (SELECT *, event_id % 11 = 0 AS is_error, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) AS age FROM usage WHERE ts <= TIMESTAMP '{NOW}'),
p AS (SELECT api_key_id, CAST(coalesce(sum(tokens) FILTER (WHERE NOT is_error AND age < 60000000), 0) AS BIGINT) AS minute_used, CAST(coalesce(sum(tokens) FILTER (WHERE NOT is_error AND age < 86400000000), 0) AS BIGINT) AS day_used,
  count(*) FILTER (WHERE is_error AND ts > coalesce(ok, TIMESTAMP '1900-01-01')) AS errors, max(age) FILTER (WHERE NOT is_error AND age < 60000000) AS oldest
  FROM e LEFT JOIN (SELECT api_key_id, max(ts) AS ok FROM e WHERE NOT is_error GROUP BY api_key_id) USING (api_key_id) GROUP BY api_key_id)
SELECT api_key_id, minute_used, day_used, errors, errors < 3 AS available, errors < 3 AND minute_used + 30 <= 60 AND day_used + 30 <= 1200 AS can_take,
  CASE WHEN minute_used + 30 <= 60 THEN 0.1 ELSE round(least(15.0, greatest(0.1, 60.5 - CAST(oldest AS DOUBLE) / 1000000)), 6) END AS wait_seconds FROM p""")
def q_key_pool(t: Tables) -> DataFrame:
    u = X.usage(t.events).where(F.col("ts") <= now()).withColumn("is_error", F.col("event_id") % 11 == 0)
    return usage.key_pool_snapshot(u, now(), 30, minute_limit=60, day_limit=1200).withColumn("wait_seconds", F.round("wait_seconds", 6))


@query(f"""WITH {X.METRICS_SQL} SELECT page_count, round(avg(total_duration_ms), 6) AS avg_duration, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY total_duration_ms), 6) AS p95_duration FROM metrics GROUP BY page_count""")
def q_dash_pages(t: Tables) -> DataFrame:
    X.metrics(t.events).createOrReplaceTempView("request_metrics")
    return t.spark.sql("SELECT page_count, round(avg(total_duration_ms), 6) AS avg_duration, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY total_duration_ms), 6) AS p95_duration FROM request_metrics GROUP BY page_count")


@query(f"WITH {X.METRICS_SQL} SELECT ocr_skipped, round(avg(total_duration_ms), 6) AS avg_duration, count(*) AS request_count FROM metrics GROUP BY ocr_skipped")
def q_dash_ocr(t: Tables) -> DataFrame:
    X.metrics(t.events).createOrReplaceTempView("request_metrics")
    return t.spark.sql("SELECT ocr_skipped, round(avg(total_duration_ms), 6) AS avg_duration, count(*) AS request_count FROM request_metrics GROUP BY ocr_skipped")


@query(f"WITH {X.METRICS_SQL} SELECT CAST(ts AS DATE) AS date, CAST(sum(total_tokens) AS BIGINT) AS daily_tokens, round(avg(total_tokens / page_count), 6) AS avg_tokens_per_page FROM metrics GROUP BY 1")
def q_dash_tokens(t: Tables) -> DataFrame:
    X.metrics(t.events).createOrReplaceTempView("request_metrics")
    return t.spark.sql("SELECT to_date(ts) AS date, sum(total_tokens) AS daily_tokens, round(avg(total_tokens / page_count), 6) AS avg_tokens_per_page FROM request_metrics GROUP BY 1")


CUT_SQL = """(SELECT list_sort(list(total_duration_ms)) FROM metrics)"""


@query(f"""WITH {X.METRICS_SQL}, v AS (SELECT list_sort(list(total_duration_ms)) AS v, count(*) AS n FROM metrics),
j AS (SELECT v, n, 19 * (n + 1) // 20 AS j95, 19 * (n + 1) % 20 AS d95, 99 * (n + 1) // 100 AS j99, 99 * (n + 1) % 100 AS d99 FROM v)
SELECT n AS total_requests, (SELECT round(avg(total_duration_ms), 6) FROM metrics) AS avg_duration_ms, (SELECT round(median(total_duration_ms), 6) FROM metrics) AS median_duration_ms,
  round((v[j95] * (20 - d95) + v[j95 + 1] * d95) / 20, 6) AS p95_duration_ms, round((v[j99] * (100 - d99) + v[j99 + 1] * d99) / 100, 6) AS p99_duration_ms,
  (SELECT round(avg(CAST(ocr_skipped AS INT)), 6) FROM metrics) AS ocr_skip_rate FROM j""")
def q_request_summary(t: Tables) -> DataFrame:
    s = quality.summary(X.metrics(t.events))
    return s.select("total_requests", *[F.round(c, 6).alias(c) for c in s.columns if c != "total_requests"])


@query(f"""WITH {X.METRICS_SQL} SELECT percentile_cont(0.95) WITHIN GROUP (ORDER BY total_duration_ms) > 15000 AS slow, avg(CAST(ocr_skipped AS INT)) < 0.4 AS gate_broken,
  sum(duplicates_removed) / sum(transactions_extracted + duplicates_removed) > 0.25 AS over_deduplicated FROM metrics""")
def q_alerts(t: Tables) -> DataFrame:
    return quality.alerts(X.metrics(t.events))


def _shared_dir(spark) -> str:
    """The folder that driver and executors share; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or tempfile.mkdtemp(prefix="ledgerloom-")


@query(f"WITH {X.USAGE_SQL} SELECT date_trunc('hour', ts) AS hour, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1")
def q_stream_hourly(t: Tables) -> DataFrame:
    kept = t.events.schema
    stream = t.spark.readStream.schema(kept).parquet(f"{t.sf_dir}/events.parquet*")
    folder = f"{_shared_dir(t.spark)}/stream-hourly-{uuid.uuid4().hex}"
    totals = jobs.hourly_totals(X.usage(stream))
    jobs.totals_in_batches(totals, f"{folder}/totals", f"{folder}/state").awaitTermination()
    return jobs.latest(t.spark.read.parquet(f"{folder}/totals"), "hour")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS client, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT client, ts, event_id, n, [epoch_us(ts)] AS times, true AS admitted FROM e WHERE n = 1
  UNION ALL SELECT e.client, e.ts, e.event_id, e.n, CASE WHEN len(f.open) < 4 THEN list_append(f.open, epoch_us(e.ts)) ELSE f.open END, len(f.open) < 4
  FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1, LATERAL (SELECT list_filter(r.times, lambda x: x > epoch_us(e.ts) - 86400000000) AS open) f)
SELECT client, ts, event_id, admitted FROM r""")
def q_rate_limit(t: Tables) -> DataFrame:
    """With a day as the period, so that there are requests which are rejected."""
    limit, _ = rates.parse_limit("4/hour")
    requests = t.events.select(F.col("user_id").alias("client"), "ts", "event_id")
    return rates.admitted(requests, limit, 86_400, order=("ts", "event_id"))
