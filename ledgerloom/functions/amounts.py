"""Amount functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AMOUNT, strip

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SIGNED_AMOUNT = r"(-?\d{1,3}(?:[,\.]\d{3})*(?:[.,]\d{2}))"
NUMERIC_CELL = r"\d[\d,]*\.?\d{0,2}"


def as_number(x: Column) -> Column:
    """A text that is a number as a whole, as a double; else null."""
    s = strip(x)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def find_amounts(x: Column) -> Column:
    """All amounts in a text, as they stand there."""
    return F.regexp_extract_all(x, F.lit(f"({AMOUNT})"), F.lit(1))


def first_amount(x: Column) -> Column:
    """The first amount with its sign, thousands commas removed; null if what is left is no number."""
    found = F.regexp_extract(F.translate(x, " ", " "), SIGNED_AMOUNT, 1)
    return as_number(F.replace(found, F.lit(","), F.lit("")))


def model_number(x: Column) -> Column:
    """Without commas and rupee signs."""
    return as_number(F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit("₹"), F.lit("")))


def table_number(x: Column) -> Column:
    """Without commas only."""
    return as_number(F.replace(x, F.lit(","), F.lit("")))


def money(x: Column) -> Column:
    """As DECIMAL(18, 2): sums don't depend on order."""
    return x.cast("decimal(18,2)")
