"""Prefix scans over rows in order, for any number of rows of one key.

Rows are sorted over the cluster and stored in parts of like size, whatever their keys. What a row takes from the
rows before it comes from its own part, and from a carry: one small row for each part, combined in order.
So no task holds more than a part, and a key with a third of all rows spreads over many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from millrace.sources.durable import stored

#: Columns that placed rows have besides their own: their part, and their place, which grows over all parts.
PART, AT = "_part", "_at"


def placed(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Rows sorted by key and order, stored, with their part and place. Rows of equal keys and order come in any order."""
    rows = df.orderBy(*keys, *order).withColumn(AT, F.monotonically_increasing_id())
    return stored(rows.withColumn(PART, F.shiftright(AT, 33)), "placed")


def running(rows: DataFrame, keys: list[str], **values: tuple[str, Column]) -> DataFrame:
    """Placed rows with running values of their key, the row itself included.

    A value is `sum`, `max` or `last` of a column; nulls are passed over, and `last` is that of the last row
    that has one. Null keys are a key. A key that lies in one part needs no carry; keys in several are at most
    as many as parts, so the carries are at most two for each part, and are broadcast.
    """
    within = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    own = rows.withColumns({f"_own_{name}": over[kind](c).over(within) for name, (kind, c) in values.items()})
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(AT)))}
    names = [f"_key{i}" for i in range(len(keys))]
    totals = rows.groupBy(PART, *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[total[kind](c).alias(f"_all_{name}") for name, (kind, c) in values.items()])
    before = Window.partitionBy(*names).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(PART).alias("_in"), *names, *[over[kind](F.col(f"_all_{name}")).over(before).alias(f"_carry_{name}") for name, (kind, _) in values.items()], F.row_number().over(Window.partitionBy(*names).orderBy(PART)).alias("_nth"))
    carried = F.broadcast(carried.filter("_nth > 1").drop("_nth"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.col(PART) == F.col("_in"))
    both = own.join(carried, same, "left")
    plus = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    joined = both.withColumns({name: plus[kind](F.col(f"_carry_{name}"), F.col(f"_own_{name}")) for name, (kind, _) in values.items()})
    return joined.select(*rows.columns, *values)


class Machine(NamedTuple):
    """What two_pass() runs over the parts of a table.

    `summary` tells of a part how it turns any state that may come in into one that goes out; `carry` gives
    the state after a part from that before it; `apply` gives a part's rows with the state that comes in, null
    for the first part.
    """

    summary: Callable[[pa.Table], bytes]
    carry: Callable[[bytes | None, bytes], bytes]
    apply: Callable[[pa.Table, bytes | None], pa.Table]

    def alone(self, parts: list[pa.Table]) -> list[pa.Table]:
        """What the parts of a small table come to, one after another in this process."""
        state, out = None, []
        for part in parts:
            out.append(self.apply(part, state))
            state = self.carry(state, self.summary(part))
        return out


def two_pass(rows: DataFrame, machine: Machine, schema: StructType) -> DataFrame:
    """Placed rows through a machine whose state goes from part to part.

    Parts are summed up and applied side by side; in between, one task takes the summaries in order, one at
    a time: a row for each part, not for each row.
    """
    summary, carry, apply = machine

    def summed(part: pa.Table) -> pa.Table:
        part = part.sort_by(AT)
        return pa.table({PART: part.column(PART).slice(0, 1), "_summary": pa.array([summary(part)], pa.binary())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            states = []
            for s in batch.column(1).to_pylist():
                states.append(state)
                state = carry(state, s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(states, pa.binary())], ["_in", "_state"])

    def applied(part: pa.Table) -> pa.Table:
        part = part.sort_by(AT)
        return apply(part.drop_columns(["_state"]), part.column("_state")[0].as_py())

    summaries = rows.groupBy(PART).applyInArrow(summed, StructType([StructField(PART, LongType()), StructField("_summary", BinaryType())]))
    states = stored(summaries.coalesce(1).sortWithinPartitions(PART).mapInArrow(fold, StructType([StructField("_in", LongType()), StructField("_state", BinaryType())])), "carries")
    return rows.join(F.broadcast(states), F.col(PART) == F.col("_in")).drop("_in").groupBy(PART).applyInArrow(applied, schema)
