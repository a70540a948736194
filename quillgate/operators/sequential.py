"""Operators whose next row depends on a small state left by the rows before it, per key.

Rows are dealt by key and sorted inside the tasks; a task reads them in batches
and carries one key's state from row to row. What is held is bounded by the
state, not by the rows of a key.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan(rows: DataFrame, fresh: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """``step(state, row)`` for the rows of each key (the first column) in the order of the next two columns: one row out for one in; null is a key of its own."""
    types = StructType.fromDDL(schema)
    out_schema = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, state = False, None, None
        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if not known or row[0] != key:
                    known, key, state = True, row[0], fresh()
                state, made = step(state, row)
                out.append(made)
            columns = list(zip(*out, strict=True)) or [()] * len(out_schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

    return rows.repartition(rows.columns[0]).sortWithinPartitions(*rows.columns[:3]).mapInArrow(run, types)


def rate_limited(requests: DataFrame, most: int, window_s: int) -> DataFrame:
    """(user_id, event_id, allowed) of requests (user_id, at, event_id): refused while ``most`` accepted ones lie within the window; refused ones are not logged."""

    def step(log: deque, row: tuple) -> tuple[deque, tuple]:
        user, at, event = row
        while log and at - log[0] >= window_s:
            log.popleft()
        allowed = len(log) < most
        if allowed:
            log.append(at)
        return log, (user, event, allowed)

    return scan(requests, deque, step, "user_id bigint, event_id bigint, allowed boolean")


def broken_circuits(calls: DataFrame, threshold: int, reset_s: int) -> DataFrame:
    """(user_id, call, state) of calls (user_id, at, event_id, failed).

    A breaker opens after ``threshold`` failures in a row and refuses calls for
    ``reset_s`` seconds; the next call is a probe that closes or reopens it.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        opened, failures = state
        user, at, event, failed = row
        if opened is not None and at - opened < reset_s:
            return state, (user, f"{event}:refused", "open")
        if not failed:
            return (None, 0), (user, f"{event}:ok", "closed")
        failures += 1
        opened = at if opened is not None or failures >= threshold else None
        return (opened, failures), (user, f"{event}:failed", "closed" if opened is None else "open")

    return scan(calls, lambda: (None, 0), step, "user_id bigint, call string, state string")


def chained(entries: DataFrame) -> DataFrame:
    """(batch_id, audit_id, previous_hash, integrity_hash) of entries (batch_id, at, audit_id, body): each hash covers the one before it, then the body."""

    def step(previous: str | None, row: tuple) -> tuple[str, tuple]:
        batch, _, entry, body = row
        own = hashlib.sha256(f"{previous or ''}|{body}".encode()).hexdigest()
        return own, (batch, entry, previous, own)

    return scan(entries, lambda: None, step, "batch_id bigint, audit_id bigint, previous_hash string, integrity_hash string")
