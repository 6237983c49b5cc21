"""Token usage: rollups, statistics, warnings, sliding sums and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import period_keys


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (then the session's)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def rollup(events: DataFrame) -> DataFrame:
    """``period, key, tokens`` by day, month and hour of ``ts, tokens``: one aggregation by hour, the coarser ones from its rows."""
    keys = period_keys(F.col("ts"))
    hourly = events.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.sum("tokens").alias("tokens"))
    exploded = hourly.select(F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(p).alias("key")) for p in ("day", "month", "hour")])).alias("p"), "tokens")
    return exploded.groupBy("p.period", "p.key").agg(F.sum("tokens").cast("long").alias("tokens"))


def usage_at(events: DataFrame, now: Column) -> DataFrame:
    """One row: tokens of the day, month and hour of ``now``."""
    keys, at = period_keys(F.col("ts")), period_keys(now)
    return events.agg(*[F.coalesce(F.sum(F.when(keys[p] == at[p], F.col("tokens"))), F.lit(0)).cast("long").alias(f"tokens_{p}") for p in ("day", "month", "hour")])


def statistics(usage: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """With limits, what remains, eligibility, possible calls and warnings."""
    hourly = settings.tokens_per_minute * 60
    left = lambda limit, c: F.greatest(F.lit(0).cast("long"), F.lit(limit).cast("long") - F.col(c))
    out = usage.withColumns({"hourly_limit": F.lit(hourly).cast("long"), "remaining_hour": left(hourly, "tokens_hour"), "remaining_month": left(settings.tokens_per_month, "tokens_month")})
    per = settings.call_tokens
    return out.withColumns({
        "eligible": (F.col("remaining_hour") >= per) & (F.col("remaining_month") >= per),
        "calls_left": F.least(F.floor(F.col("remaining_hour") / per), F.floor(F.col("remaining_month") / per)).cast("long"),
        "warnings": warnings(F.col("tokens_hour"), F.lit(hourly), F.col("tokens_month"), F.lit(settings.tokens_per_month)),
    })


def warnings(hour: Column, hour_limit: Column, month: Column, month_limit: Column) -> Column:
    """Labels from 70 and from 90 percent of a limit on."""
    def label(used: Column, limit: Column, name: str, high: str, low: str) -> Column:
        pct = F.when(limit > 0, used / limit * 100).otherwise(0.0)
        return F.when(pct >= 90, F.lit(f"{name}: {high}")).when(pct >= 70, F.lit(f"{name}: {low}"))

    return F.array_compact(F.array(label(hour, hour_limit, "hour", "rate limiting likely", "approaching limit"), label(month, month_limit, "month", "quota nearly exhausted", "monitor usage closely")))


def retained(ledger: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Keys of the last 31 days, compared as text with the key of that moment."""
    cut = period_keys(now - F.expr(f"INTERVAL {settings.retention_days} DAYS"))
    limit = F.when(F.col("period") == "day", cut["day"]).when(F.col("period") == "month", cut["month"]).otherwise(cut["hour"])
    return ledger.where(F.col("key") >= limit)


def sliding_tokens(events: DataFrame, seconds: int = 60, on: str = "api_key_id") -> DataFrame:
    """With ``window_tokens``: tokens of the key in less than ``seconds`` before and at each event."""
    w = Window.partitionBy(on).orderBy(micros("ts")).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("window_tokens", F.sum("tokens").over(w).cast("long"))


def earliest_in_window(events: DataFrame, seconds: int = 60, on: str = "api_key_id") -> DataFrame:
    w = Window.partitionBy(on).orderBy(micros("ts")).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("earliest", F.min("ts").over(w))


def keys_with_capacity(usage: DataFrame, estimate: int) -> DataFrame:
    """Keys of ``api_key_id, used, tpm_limit`` that have room for the estimate (a limit of 0 is none); if no key has, all."""
    fits = (F.col("tpm_limit") == 0) | (F.col("used") + estimate <= F.col("tpm_limit"))
    some = usage.agg(F.coalesce(F.max(fits), F.lit(False))).scalar()
    return usage.where(fits | ~some)


def too_large(estimate: Column, limit: Column) -> Column:
    return (limit > 0) & (estimate > limit)


def earliest_start(requests: DataFrame, limit: int, buffer: float = 0.05, seconds: int = 60, on: str = "api_key_id") -> DataFrame:
    """When a request could start at the earliest, had all others run when they came: at once if the tokens of its last ``seconds`` leave
    room, else ``buffer`` seconds after that use has left the window which makes room; never (null) if it alone exceeds the limit.
    A limit of 0 is none, and a request for nothing starts at once.

    The use that makes room is the first by which the key's running total reaches what the request is too much: requests and uses of a
    key are put in order of those totals, and a request takes the next use.
    """
    by_time = Window.partitionBy(on).orderBy(micros("ts"))
    upto, before = by_time.rangeBetween(Window.unboundedPreceding, 0), by_time.rangeBetween(Window.unboundedPreceding, -1)
    recent = F.coalesce(F.sum("tokens").over(by_time.rangeBetween(-(seconds * 1_000_000 - 1), -1)), F.lit(0))
    r = requests.withColumns({"_recent": recent, "_upto": F.sum("tokens").over(upto), "_over": F.coalesce(F.sum("tokens").over(before), F.lit(0)) + F.col("tokens") - limit})
    uses = r.select(on, F.col("_upto").alias("_total"), F.lit(1).alias("_kind"), F.col("ts").alias("_use"), *[F.lit(None).cast(r.schema[c].dataType).alias(c) for c in r.columns if c != on])
    asks = r.select(on, F.col("_over").alias("_total"), F.lit(0).alias("_kind"), F.lit(None).cast(r.schema["ts"].dataType).alias("_use"), *[c for c in r.columns if c != on])
    following = Window.partitionBy(on).orderBy("_total", "_kind", "_use").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = uses.unionByName(asks).withColumn("_frees", F.first("_use", ignorenulls=True).over(following)).where("_kind = 0")
    at_once = (F.lit(limit) == 0) | (F.col("tokens") <= 0) | (F.col("_recent") + F.col("tokens") <= limit)
    later = F.timestamp_micros(micros("_frees") + seconds * 1_000_000 + round(buffer * 1_000_000)).cast(requests.schema["ts"].dataType)
    start = F.when(at_once, F.col("ts")).when(F.col("tokens") <= limit, later)
    return met.select(*requests.columns, start.alias("earliest_start"))


def key_pool_snapshot(usage: DataFrame, now: Column, estimate: int, minute_limit: int = 30_000, day_limit: int = 500_000) -> DataFrame:
    """Per key of ``api_key_id, ts, tokens, is_error``: minute and day sums, errors since the last success, whether it can take the
    estimate, and the wait until its oldest use of the last minute expires (0.1 to 15 s)."""
    age = (micros(now) - micros("ts")) / 1_000_000
    ok = ~F.coalesce(F.col("is_error"), F.lit(False))
    tokens = F.when(ok, F.col("tokens")).otherwise(0)
    last_ok = F.max(F.when(ok, F.col("ts")))
    agg = usage.groupBy("api_key_id").agg(
        F.sum(F.when(age < 60, tokens).otherwise(0)).cast("long").alias("minute_used"),
        F.sum(F.when(age < 86_400, tokens).otherwise(0)).cast("long").alias("day_used"),
        F.min(F.when(ok & (age < 60), F.col("ts"))).alias("oldest"),
        last_ok.alias("last_ok"),
    )
    errors = usage.where(~ok).join(agg.select("api_key_id", "last_ok"), "api_key_id", "left").where("last_ok is null or ts > last_ok").groupBy("api_key_id").agg(F.count(F.lit(1)).alias("errors"))
    out = agg.join(errors, "api_key_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    available = F.col("errors") < 3
    wait = F.least(F.lit(15.0), F.greatest(F.lit(0.1), 60 - (micros(now) - micros("oldest")) / 1_000_000 + 0.5))
    return out.select(
        "api_key_id", "minute_used", "day_used", "errors", available.alias("available"),
        (available & (F.col("minute_used") + estimate <= minute_limit) & (F.col("day_used") + estimate <= day_limit)).alias("can_take"),
        F.when(F.col("minute_used") + estimate <= minute_limit, F.lit(0.1)).otherwise(wait).alias("wait_seconds"),
    )
