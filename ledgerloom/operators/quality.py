"""Text quality scores and request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and point scales (least count, points), best first.
DATE_PATTERNS = (
    r"\b\d{2}[-/]\d{2}[-/]\d{4}\b",
    r"\b\d{4}[-/]\d{2}[-/]\d{2}\b",
    r"(?i)\b\d{2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\b",
)
AMOUNT_PATTERNS = (r"\$?\d{1,3}(?:,\d{3})*\.\d{2}\b", r"\(\d{1,3}(?:,\d{3})*\.\d{2}\)", r"-\d{1,3}(?:,\d{3})*\.\d{2}\b")
ROW_POINTS = ((50, 30), (30, 25), (15, 20), (5, 10))
DATE_POINTS = ((20, 25), (10, 20), (5, 15), (3, 10))
AMOUNT_POINTS = ((20, 20), (10, 15), (5, 10))
LAYOUT_POINTS = ((0.8, 25), (0.5, 15), (0.3, 10))
LINES_PER_PAGE = 40
SKIP_FROM = 70
LEAST_PATTERNS = 5


def _points(x: Column, scale: tuple) -> Column:
    out = None
    for least, points in scale:
        out = F.when(x >= least, points) if out is None else out.when(x >= least, points)
    return out.otherwise(0)


def _count(x: Column, patterns: tuple[str, ...]) -> Column:
    return sum((F.regexp_count(x, F.lit(p)) for p in patterns[1:]), F.regexp_count(x, F.lit(patterns[0])))


def quality(text: Column, n_lines: Column, n_rows: Column, same_width: Column, pages: Column) -> Column:
    """``struct`` of the score (0 to 100), its counts and whether text recognition can be skipped."""
    table = F.least(F.lit(30), _points(n_rows, ROW_POINTS) + F.when((n_rows > 0) & same_width, 5).otherwise(0))
    layout = _points(n_lines / (pages * LINES_PER_PAGE), LAYOUT_POINTS)
    dates, amounts = _count(text, DATE_PATTERNS), _count(text, AMOUNT_PATTERNS)
    score = F.least(F.lit(100), table + layout + _points(dates, DATE_POINTS) + _points(amounts, AMOUNT_POINTS))
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    return F.struct(
        score.cast("int").alias("score"),
        dates.cast("int").alias("dates"),
        amounts.cast("int").alias("amounts"),
        F.when(F.length(text) > 0, digits / F.length(text)).otherwise(0.0).alias("numeric_density"),
        ((score >= SKIP_FROM) & ~((dates < LEAST_PATTERNS) & (amounts < LEAST_PATTERNS))).alias("skip_ocr"),
    )


def complete_enough(n_transactions: Column, skipped_ocr: Column, pages: Column) -> Column:
    """False if recognition was skipped and there are fewer transactions than 8 a page, or 5."""
    return ~((n_transactions < F.greatest(F.lit(5), pages * 8)) & skipped_ocr)


def cut_point(n_rows: int, n: int, k: int) -> tuple[int, float]:
    """(rank j, weight w): the k-th of n - 1 cut points by the exclusive method is (1 - w) * j-th + w * (j+1)-th value, from 1."""
    m = n_rows + 1
    j = max(1, min(k * m // n, n_rows - 1))
    return j, (k * m - j * n) / n


def summary(metrics: DataFrame) -> DataFrame:
    """Requests, mean, median, 95th and 99th percentile (exclusive method, ends extrapolated) of the duration, share of skipped recognition.

    The percentiles interpolate between two values by rank, which Spark's inclusive percentile gives exactly at (rank - 1) / (n - 1);
    so a count comes first, and one aggregation follows. With fewer than two requests the percentiles are null.
    """
    n_rows = metrics.count()
    picks = []
    for name, n, k in (("p95", 20, 19), ("p99", 100, 99)):
        if n_rows < 2:
            picks.append(F.lit(None).cast("double").alias(f"{name}_duration_ms"))
            continue
        j, w = cut_point(n_rows, n, k)
        low, high = (F.percentile("total_duration_ms", F.lit((r - 1) / (n_rows - 1))) for r in (j, j + 1))
        picks.append((low * (1 - w) + high * w).alias(f"{name}_duration_ms"))
    return metrics.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.avg("total_duration_ms").alias("avg_duration_ms"),
        F.percentile("total_duration_ms", F.lit(0.5)).alias("median_duration_ms"),
        *picks,
        F.avg(F.col("ocr_skipped").cast("int")).alias("ocr_skip_rate"),
    )


def alerts(metrics: DataFrame) -> DataFrame:
    """One row: which alert rules hold, of p95 over 15 s, a skip rate below 0.4, more than a quarter removed as duplicates."""
    p95 = F.percentile("total_duration_ms", F.lit(0.95))
    removed = F.sum("duplicates_removed") / F.nullif(F.sum(F.col("transactions_extracted") + F.col("duplicates_removed")), F.lit(0))
    return metrics.agg((p95 > 15_000).alias("slow"), (F.avg(F.col("ocr_skipped").cast("int")) < 0.4).alias("gate_broken"), F.coalesce(removed > 0.25, F.lit(False)).alias("over_deduplicated"))
