"""Calls out of a partition: retried, held to a rate, cut off while a service is down.

CTL01-06: what a job needs of them is one client per partition; Spark repeats a
task that fails, and partitions are the concurrency.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citeloom.functions.values import backoff


class Unavailable(RuntimeError):
    """The service is taken to be down."""


@dataclass
class Client:
    """``call`` with retries, at most ``per_second`` calls, and none for ``rest`` seconds after ``most_failures`` in a row."""

    call: Callable[[str], dict]
    retries: int = 3
    per_second: float = 10.0
    most_failures: int = 5
    rest: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _failures: int = field(default=0, init=False)
    _open_until: float = field(default=0.0, init=False)
    _next: float = field(default=0.0, init=False)

    def __call__(self, argument: str) -> dict:
        if self.clock() < self._open_until:
            raise Unavailable
        for attempt in range(self.retries):
            wait = self._next - self.clock()
            if wait > 0:
                self.sleep(wait)
            self._next = max(self._next, self.clock()) + 1 / self.per_second
            try:
                got = self.call(argument)
            except Exception:
                self._failures += 1
                if self._failures >= self.most_failures:
                    self._open_until, self._failures = self.clock() + self.rest, 0
                    raise
                if attempt == self.retries - 1:
                    raise
                self.sleep(backoff(attempt))
            else:
                self._failures = 0
                return got
        raise Unavailable


def fetched(asked: DataFrame, column: str, make: Callable[[], Callable[[str], dict]], fields: str, partitions: int = 8) -> DataFrame:
    """SRC17, SRC18, UDF03, CTL05: distinct values of ``column`` with what ``make()(value)`` gives, or ``error``.

    ``make`` is called once per partition. Values are asked once each, however often they occur.
    """
    schema = T.StructType([T.StructField(column, T.StringType()), *T._parse_datatype_string(f"struct<{fields}>").fields, T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            rows = []
            for v in b[column]:
                try:
                    rows.append({column: v, **client(v), "error": None})
                except Exception as e:
                    rows.append({column: v, "error": type(e).__name__})
            yield pd.DataFrame(rows, columns=names)

    distinct = asked.where(f"`{column}` is not null").select(column).distinct().repartition(partitions, column)
    return distinct.mapInPandas(run, schema)
