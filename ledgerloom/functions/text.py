"""Text functions on columns: cleaning, line predicates, row joining, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of lines, as the results have to agree on them.
AMOUNT = r"\d{1,3}(?:[,.]\d{3})*(?:[.,]\d{2})"
LINE_DATE = r"\b\d{2}[-/]\d{2}[-/]\d{2,4}\b"
NOISE = r"(?i)^(?:page\s*\d+\s*of\s*\d+|page\s*\d+|transaction(?:s)?|date|amount\s+subtracted|amount\s+added|opening\s+balance|closing\s+balance)$"
PAGE_START = r"(?i)^\s*page\s*\d+"
PAGE_OF = r"(?i)^page\s+\d+\s+of\s+\d+"
HEADER = (
    r"(?i)^(page\b|date\b|particulars\b|instrument\b|withdrawals\b|deposits\b|balance\b|client code\b|branch code\b|ifsc code\b"
    r"|branch name\b|address\b|phone\b|statement for a/c|page \d+ of|page\s*\d+)"
)
LINE_ENDS = r"\r\n|[\n\r\f\x0b\x1c\x1d\x1e\x85  ]"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_text(x: Column) -> Column:
    """Tabs become spaces, runs of white space one space, ends go."""
    return strip(F.regexp_replace(F.translate(x, "\t", " "), r"\s{2,}", " "))


def clean_or_null(x: Column) -> Column:
    """White space normalised; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def lines(x: Column) -> Column:
    """The non-empty lines, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), LINE_ENDS), strip), lambda s: s != "")


def join_cells(cells: Column, separator: str, keep_null: bool) -> Column:
    """A row's cells, stripped and joined; null cells as empty text or left out."""
    if keep_null:
        return strip(F.array_join(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), separator))
    return F.array_join(F.transform(F.filter(cells, lambda c: c.isNotNull()), strip), separator)


def is_noise(x: Column) -> Column:
    """Whether a line is null, empty, a page mark, a bare heading or two characters without a letter or digit."""
    s = strip(x)
    return x.isNull() | (x == "") | s.rlike(NOISE) | s.rlike(PAGE_START) | ((F.length(s) <= 2) & ~s.rlike(r"[A-Za-z0-9]"))


def is_header(x: Column) -> Column:
    return F.lower(x).rlike(HEADER)


def has_amount(x: Column) -> Column:
    return x.rlike(AMOUNT)


def looks_like_transaction(x: Column) -> Column:
    return x.rlike(LINE_DATE) | x.rlike(AMOUNT)


def estimate_tokens(chars: Column) -> Column:
    """0 for nothing, else a quarter of the characters, 1 at least."""
    return F.when(F.coalesce(chars, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(chars / 4))).cast("long")


def normalize_narration(x: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and white space to spaces, white space collapsed."""
    plain = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s]", " ")
    return strip(F.regexp_replace(plain, r"\s+", " "))


def is_withdrawal_narration(x: Column) -> Column:
    """Whether a narration with a single amount is a withdrawal: the word DR, or any hyphen."""
    x = F.coalesce(x, F.lit(""))
    return x.rlike(r"(?i)\bDR\b") | x.contains("-")


def bytes_as_json_text(x: Column) -> Column:
    """UTF-8 text of bytes; bytes that are none, as an object with their base64."""
    return F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")).otherwise(F.to_json(F.struct(F.base64(x).alias("__bytes_base64"))))


def period_keys(ts: Column) -> dict[str, Column]:
    return {"day": F.date_format(ts, "yyyy-MM-dd"), "month": F.date_format(ts, "yyyy-MM"), "hour": F.date_format(ts, "yyyy-MM-dd-HH")}


def bucket_of_100(x: Column) -> Column:
    """The MD5 of a text as a number, modulo 100: a fold over its 32 hex digits."""
    digits = F.filter(F.split(F.md5(x.cast("binary")), ""), lambda d: d != "")
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + _digit(d)) % 100)


def _digit(d: Column) -> Column:
    return F.conv(d, 16, 10).cast("int")
