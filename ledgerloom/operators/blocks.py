"""The block parser: lines of a statement to transactions, one document's lines in order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import AMOUNT, HEADER
from ..schemas import TRANSACTION
from .grouped import map_groups

_AMOUNT = re.compile(AMOUNT)
_DATE = re.compile(dates.BLOCK_DATE)
_HEADER = re.compile(HEADER)
_DEBIT = re.compile(r"\bDR\b|-", re.IGNORECASE)
#: A date anywhere in a line this short opens a block.
SHORT_LINE = 30


def _number(token: str) -> float | None:
    try:
        return float(token.replace(",", ""))
    except ValueError:
        return None


@dataclass
class Line:
    """A line with what the parser asks about it."""

    text: str
    amounts: list[str] = field(init=False)
    date: str | None = field(init=False)
    header: bool = field(init=False)

    def __post_init__(self) -> None:
        self.amounts = _AMOUNT.findall(self.text)
        self.header = bool(_HEADER.search(self.text.lower()))
        m = _DATE.search(self.text)
        opens = m is not None and (self.text.startswith(m.group(0)) or len(self.text) <= SHORT_LINE)
        self.date = m.group(0) if opens else None


@dataclass
class Booking:
    date: str | None
    narration: str | None = None
    withdrawal: float | None = None
    deposit: float | None = None
    balance: float | None = None


class Parser:
    """A state machine over lines: outside a block, in its narration, in its amounts.

    A date opens a block; what follows, headers left out, is narration up to a date or an amount; then all lines with amounts
    belong to it, dates or not. Amounts outside a block change the last booking.
    """

    def __init__(self) -> None:
        self.done: list[Booking] = []
        self.open: Booking | None = None
        self.words: list[str] = []
        self.amounts: list[str] | None = None  # a list once the amounts have begun
        self.last_balance: float | None = None

    def feed(self, line: Line) -> None:
        if self.open is not None and self.amounts is not None:
            if line.amounts:
                self.amounts += line.amounts
                return
            self._close()
        elif self.open is not None:
            if not line.text:
                return
            if line.date is None and line.header:
                return
            if line.date is None and not line.amounts:
                self.words.append(line.text)
                return
            if line.amounts:  # a date line too, if it has amounts: the narration ends there and its amounts follow
                self.amounts = list(line.amounts)
                return
            self._close()
        if not line.text or line.header:
            return
        if line.date is not None:
            self.open, self.words, self.amounts = Booking(line.date), [], None
        elif line.amounts and self.done:
            self._attach([_number(a) for a in line.amounts])

    def _attach(self, found: list[float | None]) -> None:
        if None in found:
            return
        last = self.done[-1]
        if len(found) >= 2:
            last.deposit, last.balance = found[-2], found[-1]
        elif last.deposit is None and last.withdrawal is None:
            last.deposit = found[0]
        else:
            last.balance = found[0]

    def _close(self) -> None:
        b = self.open
        b.narration = " ".join(self.words).strip() or None
        found = [_number(a) for a in self.amounts or ()]
        if found and None not in found:
            if len(found) >= 2:
                b.balance, value = found[-1], found[-2]
                if self.last_balance is None or b.balance > self.last_balance:
                    b.deposit = value
                else:
                    b.withdrawal = value
                self.last_balance = b.balance or self.last_balance
            elif _DEBIT.search(" ".join(self.words)):
                b.withdrawal = found[-1]
            else:
                b.deposit = found[-1]
        self.done.append(b)
        self.open, self.words, self.amounts = None, [], None

    def finish(self) -> list[Booking]:
        if self.open is not None:
            self._close()
        return self.done


def parse_lines(texts: Iterable[str]) -> list[Booking]:
    parser = Parser()
    for text in texts:
        parser.feed(Line(text.strip()))
    return parser.finish()


def parse_blocks(rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """Transactions of each document from its ``on, pos, text`` lines; dates become ISO by native functions afterwards."""

    def run(group: Iterator[tuple]) -> Iterator[tuple]:
        who = None

        def texts() -> Iterator[str]:
            nonlocal who
            for who, _, text in group:
                yield text or ""

        for i, b in enumerate(parse_lines(texts())):
            yield (who, i, b.date, b.narration, b.withdrawal, b.deposit, b.balance)

    kind = dict(rows.dtypes)[on]
    schema = [(on, kind), ("seq", "bigint"), ("raw_date", "string"), ("narration", "string"), ("withdrawal", "double"), ("deposit", "double"), ("balance", "double")]
    parsed = map_groups(rows.select(on, "pos", "text"), [on], ["pos"], run, schema)
    iso = dates.block_date(F.col("raw_date"))
    return parsed.select(on, "seq", iso.alias("tran_date"), iso.alias("value_date"), "narration", "withdrawal", "deposit", "balance")


def source_lines(table: DataFrame, layout: DataFrame, on: str = "doc_id") -> DataFrame:
    """The lines that the parser works on: a document's table rows (cells joined by spaces) if it has any, else its layout lines."""
    from ..functions.text import join_cells, strip

    rows = table.select(on, F.col("row_no").alias("pos"), join_cells(F.col("cells"), " ", False).alias("text"))
    others = layout.where(strip(F.col("text")) != "").join(table.select(on).distinct(), on, "left_anti").select(on, "pos", "text")
    return rows.unionByName(others)


__all__ = ["Booking", "Line", "Parser", "TRANSACTION", "parse_blocks", "parse_lines", "source_lines"]
