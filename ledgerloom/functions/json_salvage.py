"""JSON found in text around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def without_thinking(x: Column) -> Column:
    """Without think blocks and left-over think tags."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""), r"</?think>", ""))


def _between(x: Column, first: str, last: str) -> Column:
    a = F.instr(x, first)
    b = F.length(x) - F.instr(F.reverse(x), last) + 1
    return F.when((a > 0) & x.contains(last) & (b > a), F.substring(x, a, b - a + 1))


def _balanced_array(x: Column) -> Column:
    """From the first "[" to the "]" that closes it: a fold over the characters that keeps the depth and the end."""
    tail = F.substring(x, F.instr(x, "["), F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        at = s["at"] + 1
        done = (s["end"] == 0) & (c == "]") & (depth == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(done, at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])
    return F.when(x.contains("[") & (end > 0), F.substring(tail, F.lit(1), end))


def _line_starts(t: Column) -> Column:
    """The text from each line on that begins an object or a list."""
    own = F.split(t, r"\r\n|[\n\r]")
    return F.filter(
        F.transform(own, lambda line, i: F.when(F.ltrim(line).rlike(r"^[\{\[]"), F.array_join(F.slice(own, i + 1, F.greatest(F.size(own), F.lit(1))), "\n"))),
        lambda s: s.isNotNull(),
    )


def candidates(t: Column) -> list[Column]:
    """Arrays of the parts of a text without thinking that may be JSON, in the order in which they are tried; parts may be null."""
    part = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    first = [t, part(r"(?is)```json\s*(\{.*?\})\s*```"), part(r"(?s)```\s*(\{.*?\}|\[.*?\])\s*```"), _between(t, "{", "}")]
    return [*map(F.array, first), _line_starts(t), F.array(_between(t, "[", "]")), F.array(_balanced_array(t))]


def is_json(x: Column) -> Column:
    """Whether a text is one JSON value and nothing else: the parser alone would pass over what follows the value."""
    inside_array = F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1
    return F.coalesce(inside_array, F.lit(False)) & F.try_parse_json(F.concat(F.lit('{"x":'), x, F.lit("}"))).isNotNull()


def salvage_json(x: Column) -> Column:
    """The first candidate that parses, as JSON text; null if none does.

    The text is bound once, and a candidate is made only if none before it parses.
    """
    first = lambda parts: F.get(F.filter(parts, lambda s: s.isNotNull() & is_json(s)), F.lit(0))
    return F.get(F.transform(F.array(without_thinking(x)), lambda t: F.coalesce(*map(first, candidates(t)))), F.lit(0))


def retry_after_seconds(message: Column) -> Column:
    """Seconds of "try again in Ns" or "Nms" in the message of an error's JSON; 0 without."""
    text = F.coalesce(F.get_json_object(message, "$.error.message"), F.lit(""))
    number = F.regexp_extract(text, r"(?i)try again in ([0-9]+(?:\.[0-9]+)?)(ms|s)", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)try again in ([0-9]+(?:\.[0-9]+)?)(ms|s)", 2))
    return F.when(number == "", F.lit(0.0)).when(unit == "ms", number.try_cast("double") / 1000).otherwise(number.try_cast("double"))
