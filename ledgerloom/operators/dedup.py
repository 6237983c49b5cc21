"""Removal of duplicate transactions with survival of the fuller record."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.amounts import money
from ..functions.text import normalize_narration, strip
from .grouped import map_groups


def completeness() -> Column:
    """3 for a balance, 2 each for withdrawal and deposit, 1 for a narration of more than 10 characters."""
    there = lambda c, n: F.col(c).isNotNull().cast("int") * n
    return there("balance", 3) + there("withdrawal", 2) + there("deposit", 2) + (F.length(strip(F.coalesce("narration", F.lit("")))) > 10).cast("int")


def amount() -> Column:
    """Deposit, or if that is null or 0, withdrawal, or 0."""
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    return money(F.coalesce(nonzero("deposit"), nonzero("withdrawal"), F.lit(0.0)))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_narr": normalize_narration(F.col("narration")), "_amt": amount(), "_bal": money(F.col("balance")), "_score": completeness()})


_KEYS = ("_narr", "_amt", "_bal", "_score")


def drop_exact(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """Of the rows with one (document, date, normalised narration, amount, balance), that with the highest score, of equal ones
    the first. Undated rows all stay. One window; a row keeps its own ``seq``."""
    best = Window.partitionBy(on, "tran_date", "_narr", "_amt", "_bal").orderBy(F.col("_score").desc(), F.col("seq"))
    k = _keyed(rows).withColumn("_undated", F.coalesce("tran_date", F.lit("")) == "")
    return k.withColumn("_nth", F.row_number().over(best)).where("_nth = 1 or _undated").drop(*_KEYS, "_nth", "_undated")


def similar(one: str, matcher: SequenceMatcher, ratio: float) -> bool:
    """Whether a text is alike to the matcher's second one; cheap bounds are asked first."""
    if one == matcher.b:
        return True
    matcher.set_seq1(one)
    return matcher.real_quick_ratio() >= ratio and matcher.quick_ratio() >= ratio and matcher.ratio() >= ratio


def drop_fuzzy(rows: DataFrame, ratio: float = DEFAULTS.fuzzy_ratio, on: str = "doc_id") -> DataFrame:
    """The exact and the fuzzy rule together, in the order of ``seq``, as they depend on each other.

    A row is a duplicate of an earlier kept key with its date and amount (not 0) if their narrations are alike to ``ratio``; the first
    such key takes the fuller record but keeps its own narration. Both rules ask for the same document, date and amount, so rows
    are grouped by those. Rows of a group with one narration share their fate whatever their balances, so they become one before:
    the fullest, at the place of the first. Only groups of several narrations need Python. (An amount of 0 is never alike: those
    rows go by the exact rule alone.) ``slot`` is the place in the output.
    """
    k = _keyed(rows).withColumn("_undated", F.coalesce("tran_date", F.lit("")) == "")
    day = [on, "tran_date", "_amt"]
    same = Window.partitionBy(*day, "_narr", F.when(F.col("_amt") == 0, F.col("_bal")), "_undated")
    fullest = k.withColumn("_nth", F.row_number().over(same.orderBy(F.col("_score").desc(), F.col("seq"))))
    place = F.col("seq").cast("bigint")
    fullest = fullest.withColumn("slot", F.when(F.col("_undated"), place).otherwise(F.min(place).over(same))).where("_nth = 1 or _undated").drop("_nth")
    fullest = fullest.withColumn("_n", F.count(F.when((F.col("_amt") != 0) & ~F.col("_undated"), 1)).over(Window.partitionBy(*day))).drop("_undated")
    alone, several = fullest.where("_n <= 1").drop("_n"), fullest.where("_n > 1").drop("_n")
    columns = several.columns
    narr, score, seq, slot = (columns.index(c) for c in ("_narr", "_score", "seq", "slot"))

    def greedy(group: Iterator[tuple]) -> Iterable[tuple]:
        kept: list[list] = []  # (narration, place, fullest row)
        for row in group:
            matcher = SequenceMatcher(None, "", row[narr])
            target = next((x for x in kept if similar(x[0], matcher, ratio)), None)
            if target is None:
                kept.append([row[narr], row[slot], row])
            elif (-row[score], row[seq]) < (-target[2][score], target[2][seq]):
                target[2] = row
        return [(*row[:slot], place, *row[slot + 1 :]) for _, place, row in kept]

    solved = map_groups(several, day, ["slot"], greedy, [(f.name, f.dataType.simpleString()) for f in several.schema.fields])
    return solved.unionByName(alone).drop(*_KEYS)


def similar_pairs(rows: DataFrame, max_share: float = 0.1, on: str = "doc_id") -> DataFrame:
    """Pairs of one (document, date, amount other than 0) whose narrations differ by Levenshtein distance in at most a share of the longer."""
    k = _keyed(rows).where((F.col("_amt") != 0) & (F.coalesce("tran_date", F.lit("")) != "")).select(on, "tran_date", "_amt", "_narr", "seq")
    a, b = k.alias("a"), k.select(on, "tran_date", "_amt", F.col("_narr").alias("other"), F.col("seq").alias("other_seq"))
    pairs = a.join(b, [on, "tran_date", "_amt"]).where("seq < other_seq")
    longest = F.greatest(F.length("_narr"), F.length("other"))
    return pairs.withColumn("distance", F.levenshtein("_narr", "other")).where(F.col("distance") <= longest * max_share).select(on, "seq", "other_seq", "distance")


def hash_key() -> Column:
    """MD5 of date, absolute amount to cents and the description without punctuation."""
    plain = F.regexp_replace(F.lower(F.coalesce("narration", F.lit(""))), r"[^\w\s]", "")
    text = strip(F.regexp_replace(plain, r"\s+", " "))
    return F.md5(F.concat_ws("|", F.coalesce("tran_date", F.lit("")), F.abs(amount()).cast("string"), text).cast("binary"))


def drop_by_hash(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """The first row of each hash key in a document."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(on, hash_key()).orderBy("seq"))).where("_nth = 1").drop("_nth")


def three_passes(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """Exact by hash, fuzzy to 0.85 with amounts a cent apart at most, exact again by page.

    The fuzzy pass replays each (document, date) in order; groups are one day of one document.
    """
    first = drop_by_hash(rows, on).withColumn("_amount", F.abs(amount()).cast("double"))
    full = F.coalesce((F.col("balance") != 0).cast("double"), F.lit(0.0)) + F.length(F.coalesce("narration", F.lit(""))) / 100 + F.coalesce((F.col("page_no") != 0).cast("double"), F.lit(0.0))
    first = first.withColumn("_full", full).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(on, "tran_date")))
    alone, several = first.where("_n = 1").drop("_n"), first.where("_n > 1").drop("_n")
    columns = several.columns
    narr, amt, fullness = (columns.index(c) for c in ("narration", "_amount", "_full"))

    def fuzzy(group: Iterator[tuple]) -> Iterable[tuple]:
        kept: list[tuple] = []
        for row in group:
            text = (row[narr] or "").lower()
            near = (i for i, x in enumerate(kept) if abs(row[amt] - x[amt]) <= 0.01 and similar(text, SequenceMatcher(None, "", (x[narr] or "").lower()), 0.85))
            same = next(near, None)
            if same is None:
                kept.append(row)
            elif row[fullness] > kept[same][fullness]:
                del kept[same]
                kept.append(row)
        return kept

    solved = map_groups(several, [on, "tran_date"], ["seq"], fuzzy, [(f.name, f.dataType.simpleString()) for f in several.schema.fields])
    second = solved.unionByName(alone).drop("_amount", "_full")
    by_page = Window.partitionBy(on, F.coalesce("page_no", F.lit(0)), hash_key()).orderBy("seq")
    return second.withColumn("_nth", F.row_number().over(by_page)).where("_nth = 1").drop("_nth")


def loss_rates(before: DataFrame, after: DataFrame, on: str = "doc_id") -> DataFrame:
    """The share of each document's rows that went, and whether it is more than a fifth."""
    a, b = before.groupBy(on).agg(F.count(F.lit(1)).alias("n")), after.groupBy(on).agg(F.count(F.lit(1)).alias("left"))
    rate = 1 - F.coalesce("left", F.lit(0)) / F.col("n")
    return a.join(b, on, "left").select(on, rate.alias("loss_rate"), (rate > 0.2).alias("suspicious"))
