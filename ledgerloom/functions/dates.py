"""Date parsers on columns: four of them, which accept different formats; all give ISO text or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Shapes of the accepted formats; years of two digits from 69 on are of the last century.
SHAPES = {
    "Y-m-d": (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    "Y/m/d": (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    "d-m-Y": (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    "d/m/Y": (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    "d-m-y": (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-y"),
    "d/m/y": (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/y"),
    "d B Y": (r"^\d{1,2} \p{L}+ \d{4}$", "d MMMM y"),
    "d b Y": (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM y"),
}
NORMALIZER = ("Y-m-d", "d-m-Y", "d/m/Y", "d-m-y", "Y/m/d")
METADATA = ("d-m-Y", "d/m/Y", "Y-m-d", "d B Y", "d b Y")
METADATA_TOKEN = ("d-m-Y", "d/m/Y", "Y-m-d", "d-m-y", "d/m/y")
BLOCK_TOKEN = ("d-m-Y", "d/m/Y", "Y-m-d")
TOKEN = r"(\d{4}-\d{2}-\d{2}|\d{2}[\-/]\d{2}[\-/]\d{2,4})"
BLOCK_DATE = r"(\d{2}[\-/]\d{2}[\-/]\d{2,4}|\d{4}[\-/]\d{2}[\-/]\d{2})"


def _one(x: Column, name: str) -> Column:
    shape, pattern = SHAPES[name]
    if name.endswith("y"):
        short = F.regexp_extract(x, r"(\d{2})$", 1)
        x4 = F.concat(F.expr("''"), F.regexp_extract(x, r"^(.*)\d{2}$", 1), F.when(short >= "69", F.lit("19")).otherwise(F.lit("20")), short)
        return F.when(x.rlike(shape), F.try_to_date(x4, pattern))
    if "B" in name or "b" in name:
        x = F.initcap(x)
    return F.when(x.rlike(shape), F.try_to_date(x, pattern))


def by_formats(x: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_one(x, n) for n in names])


def _token(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def _iso(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def normalizer_date(x: Column) -> Column:
    """Five formats on the text, else on its first date-like part."""
    s = strip(x)
    return _iso(F.coalesce(by_formats(s, NORMALIZER), by_formats(_token(s, TOKEN), NORMALIZER)))


def validator_date(x: Column) -> Column:
    """As the normaliser; a text without a parsable date gives null."""
    return normalizer_date(x)


def metadata_date(x: Column) -> Column:
    """After every "st", "nd", "rd" and "th" went: five formats, else the first date-like part by five others."""
    s = strip(F.regexp_replace(x, "st|nd|rd|th", ""))
    whole = by_formats(F.regexp_replace(s, r"\s+", " "), METADATA)
    return _iso(F.coalesce(whole, by_formats(_token(s, TOKEN), METADATA_TOKEN)))


def block_date(x: Column) -> Column:
    """Five formats, else the first date-like part by three."""
    s = strip(x)
    return _iso(F.coalesce(by_formats(s, NORMALIZER), by_formats(_token(s, BLOCK_DATE), BLOCK_TOKEN)))
