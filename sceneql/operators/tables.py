"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from sceneql.operators.groups import AT_ONCE
from sceneql.operators.selection import knapsacks, many_ticks
from sceneql.sources.package import ship

_RETURNS = {"k": pa.int64(), "ord": pa.int64(), "value": pa.float64(), "cost": pa.float64()}


def _starts(key: pa.Array) -> np.ndarray:
    """Where a key's rows begin; null is a key like others."""
    null, own = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (null[1:] != null[:-1])))


@arrow_udtf(returnType="k bigint, ord bigint, value double, cost double")
class BudgetSelect:
    """budget_select(TABLE(t) PARTITION BY p ORDER BY k, ord, budget, step): each key's rows that are worth most within the budget.

    t: key, order, value, cost; p: the key, or any expression of it that puts many keys in a partition. Spark streams a
    partition's rows in order; the keys that are whole are solved together once many rows have come. Costs are rounded to
    steps, one at least; of equal sums the one of more rows wins.
    """

    def __init__(self):
        self.held: list[pa.Table] = []
        self.rows, self.budget, self.step = 0, 0.0, 1.0

    def eval(self, rows: pa.RecordBatch, budget: pa.Array, step: pa.Array) -> Iterator[pa.Table]:
        if len(rows):
            self.budget, self.step = float(budget[0].as_py()), float(step[0].as_py())
            self.held.append(pa.table([rows.column(i).cast(t) for i, t in enumerate(_RETURNS.values())], names=list(_RETURNS)))
            self.rows += len(rows)
        if self.rows > AT_ONCE:
            yield from self._solved(True)

    def terminate(self) -> Iterator[pa.Table]:
        yield from self._solved(False)

    def _solved(self, open_: bool) -> Iterator[pa.Table]:
        """What is chosen among the held rows; open_: more rows of the last key may come, so these are held on."""
        if not self.rows:
            return
        t = pa.concat_tables(self.held).combine_chunks()
        first = np.append(_starts(t.column(0).combine_chunks()), len(t))
        if open_:
            first = first[:-1]
        self.held, self.rows = [t.slice(first[-1])], len(t) - int(first[-1])
        if len(first) < 2:
            return
        t = t.slice(0, first[-1])
        if t.column(2).null_count:
            raise ValueError("a value is null")
        value, cost = (pc.fill_null(t.column(i), float("nan")).to_numpy() for i in (2, 3))
        room = np.full(len(first) - 1, round(self.budget / self.step))
        yield t.filter(pa.array(knapsacks(np.maximum(value, 1e-6), many_ticks(np.maximum(0.05, cost), self.step, "round"), first, room, more_items=True)))


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL; workers get the library."""
    ship(spark)
    spark.udtf.register("budget_select", BudgetSelect)
