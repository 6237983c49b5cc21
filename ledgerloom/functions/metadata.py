"""Statement metadata from text, as column expressions, and balances from table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import as_number, first_amount
from .dates import metadata_date
from .text import clean_or_null, lines

# Names and patterns in the order in which they are tried.
BANKS = ("AXIS", "UCO", "HDFC", "ICICI", "SBI", "KOTAK", "YES BANK", "PNB", "BANK OF INDIA")
DETERMINISTIC_BANKS = ("uco bank", "axis bank", "state bank of india", "sbi")
ACCOUNT = (
    r"(?i)A/C\s*[: ]\s*([0-9Xx\*\-]{4,20})",
    r"(?i)ACCOUNT\s*NO\.?\s*[: ]\s*([0-9Xx\*\-]{4,20})",
    r"(?i)ACCOUNT\s*NUMBER\s*[: ]\s*([0-9Xx\*\-]{4,20})",
)
NAME = r"(?i)(?:CUSTOMER NAME|NAME|ACCOUNT NAME)[:\s]*([A-Z][A-Z\s\.,&-]{3,100})"
IFSC = r"([A-Z]{4}[0-9]{7})"
MICR = r"\b(\d{9})\b"
BETWEEN = r"(?i)BETWEEN\s+(.+?)\s+TO\s+(.+?)\n"
FROM_TO = r"(?i)STATEMENT\s+FROM\s+(.+?)\s+TO\s+(.+?)\n"
DATES = r"(\d{2}[\-/]\d{2}[\-/]\d{2,4}|\d{4}-\d{2}-\d{2})"
OPENING = r"OPENING\s+BALANCE\s*[:\-]?\s*([0-9,]+\.?[0-9]{0,2})"
CLOSING = r"CLOSING\s+BALANCE\s*[:\-]?\s*([0-9,]+\.?[0-9]{0,2})"


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def bank_name(text: Column) -> Column:
    up = F.upper(text)
    return F.coalesce(*[F.when(up.contains(b), F.lit(b)) for b in BANKS])


def account_number(text: Column) -> Column:
    """Digits and X of the first labelled form; without any of those (or a label), the first run of 8 to 20 digits."""
    up = F.upper(text)
    labelled = F.coalesce(*[_part(up, p) for p in ACCOUNT])
    return F.coalesce(F.nullif(F.regexp_replace(labelled, "[^0-9Xx]", ""), F.lit("")), _part(text, r"(\d{8,20})"))


def account_name(text: Column) -> Column:
    """What follows a name label; else the first line in capitals of 4 to 79 characters."""
    capital = F.get(F.filter(lines(text), lambda s: (s == F.upper(s)) & (s != F.lower(s)) & F.length(s).between(4, 79)), F.lit(0))
    return F.when(text.rlike(NAME), clean_or_null(_part(text, NAME))).otherwise(clean_or_null(capital))


def ifsc(text: Column) -> Column:
    return _part(F.upper(text), IFSC)


def micr(text: Column) -> Column:
    return _part(text, MICR)


def period(text: Column) -> tuple[Column, Column]:
    """Dates of "between .. to ..", else "statement from .. to ..", else the first two dates if there are two."""
    found = F.regexp_extract_all(text, F.lit(DATES), F.lit(1))
    out = []
    for i in (1, 2):
        labelled = F.when(text.rlike(BETWEEN), _part(text, BETWEEN, i)).when(text.rlike(FROM_TO), _part(text, FROM_TO, i))
        either = text.rlike(BETWEEN) | text.rlike(FROM_TO)
        out.append(F.when(either, metadata_date(labelled)).otherwise(F.when(F.size(found) >= 2, metadata_date(F.get(found, F.lit(i - 1))))))
    return out[0], out[1]


def labelled_balance(text: Column, pattern: str) -> Column:
    return as_number(F.replace(_part(F.upper(text), pattern), F.lit(","), F.lit("")))


def metadata_of(texts: DataFrame, text: str = "text", on: str = "doc_id") -> DataFrame:
    """The nine metadata fields of each document's text: one projection."""
    t = F.col(text)
    start, end = period(t)
    return texts.select(
        on,
        account_number(t).alias("account_number"),
        account_name(t).alias("account_name"),
        bank_name(t).alias("bank_name"),
        ifsc(t).alias("ifsc"),
        micr(t).alias("micr"),
        start.alias("period_start"),
        end.alias("period_end"),
        labelled_balance(t, OPENING).alias("opening_balance"),
        labelled_balance(t, CLOSING).alias("closing_balance"),
    )


def balances_of_rows(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """``opening_balance, closing_balance``: first and last amount of the balance column, else of the last cells.

    The balance column is that of the first cell that holds BALANCE in the first three rows. One aggregation by document finds
    the column; a second one takes both kinds of amounts.
    """
    place = F.array_position(F.transform("cells", lambda c: F.coalesce(F.upper(c).contains("BALANCE"), F.lit(False))), True)
    header = rows.where("row_no < 3").select(on, "row_no", F.nullif(place, F.lit(0)).alias("place")).where("place is not null")
    header = header.groupBy(on).agg(F.min_by("place", "row_no").alias("place"))
    cell = F.get("cells", (F.col("place") - 1).cast("int"))
    last = F.when(F.size("cells") > 1, F.get("cells", F.size("cells") - 1))
    both = rows.join(header, on, "left").select(on, "row_no", first_amount(cell).alias("own"), first_amount(last).alias("last"))
    agg = []
    for kind in ("own", "last"):
        there = F.when(F.col(kind).isNotNull(), F.col("row_no"))
        agg += [F.min_by(kind, there).alias(f"{kind}_first"), F.max_by(kind, there).alias(f"{kind}_last")]
    out = both.groupBy(on).agg(*agg)
    own = F.col("own_first").isNotNull()
    return out.select(on, F.when(own, F.col("own_first")).otherwise(F.col("last_first")).alias("opening_balance"), F.when(own, F.col("own_last")).otherwise(F.col("last_last")).alias("closing_balance"))


def routes_to_parser(bank: Column) -> Column:
    """Whether a bank's statements go to the deterministic parser."""
    return F.lower(F.coalesce(bank, F.lit(""))).isin(*DETERMINISTIC_BANKS)
