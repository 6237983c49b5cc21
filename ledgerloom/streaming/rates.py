"""Rate limits: a request is admitted if fewer than the limit were admitted in the period before it; rejected ones don't count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = {"hour": 3600, "sec": 1, "second": 1, "minute": 60}


def parse_limit(text: str) -> tuple[int, int]:
    """(requests, seconds) of "4/minute"; an unknown unit is a minute."""
    n, _, unit = text.partition("/")
    unit = unit.strip().lower()
    seconds = next((s for name, s in UNITS.items() if unit.startswith(name)), 60)
    return int(n), seconds


def admit(times: deque[int], now: int, limit: int, period: int) -> bool:
    """Whether a request at ``now`` (microseconds) is admitted; ``times``: the admitted ones, which it updates."""
    while times and times[0] <= now - period:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def admitted(requests: DataFrame, limit: int, seconds: int, client: str = "client", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """With ``admitted``, over a table: clients are dealt by hash, sorted by time and streamed; a task keeps one client's last times."""
    period = seconds * 1_000_000
    dealt = requests.withColumn("_micros", F.unix_micros(F.col(order[0]).cast("timestamp"))).repartition(client).sortWithinPartitions(client, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: deque[int] = deque()
        last = object()
        for batch in batches:
            flags = []
            for who, now in zip(batch.column(client).to_pylist(), batch.column("_micros").to_pylist(), strict=True):
                if who != last:
                    last, times = who, deque()
                flags.append(admit(times, now, limit, period))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "admitted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", admitted boolean"
    return dealt.mapInArrow(run, schema).drop("_micros")


def admitted_stream(requests: DataFrame, limit: int, seconds: int, evict: bool = False) -> DataFrame:
    """The same over a stream of ``client, ts``: the admitted times, ``limit`` at most, are the client's state.

    ``evict``: for streams that never end, state goes a period after the client's last request by the clock (such a query
    keeps running batches for that, so it must not be run for what is available only).
    """
    period = seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        rows["admitted"] = [admit(times, int(now), limit, period) for now in micros]
        state.update((list(times),))
        if evict:
            state.setTimeoutDuration(seconds * 1000)
        yield rows[["client", "ts", "admitted"]]

    timeout = "ProcessingTimeTimeout" if evict else "NoTimeout"
    return requests.groupBy("client").applyInPandasWithState(run, "client string, ts timestamp, admitted boolean", "times array<bigint>", "append", timeout)
