"""Groups of rows through Python, many to an Arrow batch: for rules that depend on the order of a group's rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
#: Rows of one batch that goes back.
ROWS = 4000


def map_groups(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: list[tuple[str, str]]) -> DataFrame:
    """``fn`` of each group's rows (tuples of the columns of ``rows``, by ``order``), which it may read one by one; its tuples have ``schema``.

    Rows are dealt by their keys and sorted, and a task streams one group after the other: no frame is made for a group, and
    of a group nothing is held but what ``fn`` keeps. Columns that keep their names keep their types.
    """
    at = [rows.columns.index(k) for k in keys]

    def key(row: tuple) -> tuple:
        return tuple(row[i] for i in at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def stream() -> Iterator[tuple]:
            for batch in batches:
                kinds.update({f.name: f.type for f in batch.schema})
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        made = itertools.chain.from_iterable(fn(group) for _, group in itertools.groupby(stream(), key))
        while part := list(itertools.islice(made, ROWS)):
            columns = [pa.array(list(c), kinds.get(name) or _KINDS[kind]) for (name, kind), c in zip(schema, zip(*part, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in schema])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in schema))
