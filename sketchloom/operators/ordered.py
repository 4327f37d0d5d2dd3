"""Folds over the ordered rows of each key, streamed in Arrow batches.

A task reads its rows sorted by key and order and holds one batch and one key's state, so
a key's rows never have to fit in memory.  One key is still one task: its order is the
operator's meaning.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def _values(column: pa.Array) -> list:
    """Plain values; times are microseconds and all NaN are one value."""
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_pylist()
    if pa.types.is_floating(column.type):
        return ["NaN" if x is not None and x != x else x for x in column.to_pylist()]
    return column.to_pylist()


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable, step: Callable, outputs: str) -> DataFrame:
    """``df`` with the columns ``outputs``: what ``step(state, *inputs)`` returns, row by row.

    ``start()`` makes the state of a new key; ``step`` changes it in place.  Nulls sort
    first and are a key of their own.  Without keys all rows are one sequence in one task.
    """
    places = {c: df.columns.index(c) for c in [*keys, *inputs]}
    added = [c.split() for c in outputs.split(", ")]
    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC")}

    def run(batches):
        key = state = None
        for batch in batches:
            columns = {c: _values(batch.column(k)) for c, k in places.items()}
            own = zip(*(columns[c] for c in keys), strict=True) if keys else [()] * batch.num_rows
            rows = []
            for k, values in zip(own, zip(*(columns[c] for c in inputs), strict=True), strict=True):
                if state is None or k != key:
                    key, state = k, start()
                rows.append(step(state, *values))
            new = [pa.array([r[j] for r in rows], arrow[kind]) for j, (_, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(c for c, _ in added)])

    return _sorted(df, keys, order).mapInArrow(run, f"{kinds}, {outputs}")


def _sorted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order)


def fold_to_rows(df: DataFrame, keys: list[str], order: list, item: str, start: Callable, step: Callable, rows: Callable, outputs: str) -> DataFrame:
    """(keys, outputs): the tuples that ``rows(state)`` gives at the end of each key, after ``step(state, item)`` row by row.

    Held are a batch, one key's state and its rows, of which there is at least one.  Nulls are a key of their own.
    """
    at, place = [df.columns.index(c) for c in keys], df.columns.index(item)
    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in keys), outputs])
    added = [c.split()[0] for c in outputs.split(", ")]

    def ended(head, state):
        found = rows(state)
        columns = [c.take(pa.array([0] * len(found), pa.int64())) for c in head]
        new = [pa.array(list(c)) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *new], [*keys, *added])

    def run(batches):
        key = head = state = None
        for batch in batches:
            own = zip(*(_values(batch.column(k)) for k in at), strict=True) if keys else [()] * batch.num_rows
            for j, (k, x) in enumerate(zip(own, batch.column(place).to_pylist(), strict=True)):
                if state is None or k != key:
                    if state is not None:
                        yield ended(head, state)
                    key, state = k, start()
                    head = [pa.array(batch.column(c).slice(j, 1).to_pylist(), batch.schema.field(c).type) for c in at]  # a copy: the batch can go
                step(state, x)
        if state is not None:
            yield ended(head, state)

    return _sorted(df, keys, order).mapInArrow(run, schema)
