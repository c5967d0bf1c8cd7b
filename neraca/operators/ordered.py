"""Ranks, running sums and predecessors along an order, safe for hot keys.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.  Keys of more than ``SLICE_ROWS`` rows,
found by one count of the key columns, are therefore dealt by range of (key, order) instead and written once: a
range partition holds one slice or the ends of several keys.  Slices are windowed separately and each one
starts from what the slices before it carry over.  Where no key is that large, which is the rule, the plan is one
window over one scan of the input.

Rows that are equal in every order column stay together, so days with most of the rows make no slice larger as long
as the order goes on.  There are at most ``PARTS`` slices and ``PARTS`` keys that are cut, whatever the data size; that
bounds what is broadcast below.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neraca.session import cut_lineage

PARTS = 10_000
SLICE_ROWS = 1_000_000
#: As ``slice_rows``, for a caller who knows that no key is large: nothing is counted or cut.
NO_SLICES = -1
#: Rows of a slice that ``first_free`` sums up, and a limit that lets anyone in.
FREE_ROWS = 100_000
ANYONE = 1 << 62

_SLICE = "_slice"


def _order_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


class _Sliced(NamedTuple):
    rows: DataFrame  # with _slice, null for keys of one slice
    hot: DataFrame | None  # the rows of keys that are cut, as written
    ties: list[str]  # the order, as columns


def _sliced(df: DataFrame, keys: list[str], order: list[Column], slice_rows: int | None) -> _Sliced:
    limit = SLICE_ROWS if slice_rows is None else slice_rows
    ties = [f"_o{i}" for i in range(len(order))]
    tied = df.select("*", *[c.alias(t) for c, t in zip(order, ties, strict=True)])
    whole = tied.withColumn(_SLICE, F.lit(None).cast("int"))
    if limit == NO_SLICES:
        return _Sliced(whole, None, ties)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    found = sizes.orderBy(F.desc("_rows")).limit(PARTS).collect()
    if not found:
        return _Sliced(whole, None, ties)
    slices = max(2, min(PARTS, -(-sum(r["_rows"] for r in found) // limit)))
    schema = T.StructType([T.StructField(f"_hot_{k}", df.schema[k].dataType) for k in keys])
    cut = F.broadcast(df.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], schema))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    ranged = tied.join(cut, same, "left_semi").repartitionByRange(slices, *keys, *ties)
    hot = cut_lineage(ranged.withColumn(_SLICE, F.spark_partition_id()))
    return _Sliced(whole.join(cut, same, "left_anti").unionByName(hot), hot, ties)


def with_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], slice_rows: int | None = None) -> DataFrame:
    """Add ``_slice``: null for keys of one slice, else a number that rises along the order of the row's key.

    ``order`` holds columns in ascending order.
    """
    found = _sliced(df, list(keys), _order_columns(order), slice_rows)
    return found.rows.drop(*found.ties)


def _carry(hot: DataFrame, keys: list[str], summary: Column, combine: Callable[[Column], Column], back: bool = False) -> DataFrame:
    """Per slice of a hot key, the value that the slices before it (behind it, if ``back``) hand over."""
    per_slice = hot.groupBy(*keys, _SLICE).agg(summary.alias("_summary"))
    w = Window.partitionBy(*keys).orderBy(F.desc(_SLICE) if back else F.asc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col(_SLICE).alias("_c_slice"),
        combine(F.col("_summary")).over(w).alias("_carry"),
    )


def _attach(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    same.append(F.col(_SLICE) == F.col("_c_slice"))
    return rows.join(F.broadcast(carry), same, "left").drop("_c_slice", *[f"_c_{k}" for k in keys])


def _scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, slice_rows: int | None,
    local: Callable[[object, list[Column]], Column], summary: Callable[[list[Column]], Column], combine: Callable[[Column], Column],
    merge: Callable[[Column, Column], Column], back: bool = False,
) -> DataFrame:
    """``local`` over each slice in order (from its end, if ``back``), merged with what ``combine`` makes of the ``summary`` of others."""
    keys = list(keys)
    cut = _sliced(df, keys, _order_columns(order), slice_rows)
    ties = [F.col(t) for t in cut.ties]
    w = Window.partitionBy(*keys, _SLICE) if cut.hot is not None else Window.partitionBy(*keys)
    w = w.orderBy(*([F.desc_nulls_last(t) for t in cut.ties] if back else ties))
    found = cut.rows.withColumn(name, local(w, ties))
    if cut.hot is not None:
        kind = found.schema[name].dataType
        found = _attach(found, _carry(cut.hot, keys, summary(ties), combine, back), keys)
        found = found.withColumn(name, merge(F.col(name), F.col("_carry")).cast(kind)).drop("_carry")
    return found.drop(*cut.ties, _SLICE)


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, slice_rows: int | None = None
) -> DataFrame:
    """``row_number`` of every row inside its key."""
    return _scan(
        df, keys, order, name, slice_rows,
        local=lambda w, ties: F.row_number().over(w).cast("long"),
        summary=lambda ties: F.count(F.lit(1)),
        combine=F.sum,
        merge=lambda own, carry: own + F.coalesce(carry, F.lit(0)),
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, slice_rows: int | None = None
) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to and including this row."""
    valued = df.withColumn("_value", value)
    return _scan(
        valued, keys, order, name, slice_rows,
        local=lambda w, ties: F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        summary=lambda ties: F.sum("_value"),
        combine=F.sum,
        merge=lambda own, carry: F.when(carry.isNull(), own).otherwise(F.coalesce(own, F.lit(0)) + carry),
    ).drop("_value")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, name: str, slice_rows: int | None = None
) -> DataFrame:
    """``lag(value, 1)``: the value of the row before this one in its key."""
    held = F.struct(F.col(value).alias("v"))
    found = _scan(
        df, keys, order, name, slice_rows,
        local=lambda w, ties: F.lag(held).over(w),
        summary=lambda ties: F.max_by(held, F.struct(*ties)),
        combine=lambda c: F.last(c, ignorenulls=True),
        merge=lambda own, carry: F.coalesce(own, carry),
    )
    return found.withColumn(name, F.col(f"{name}.v"))


def nearest_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, slice_rows: int | None = None, back: bool = False
) -> DataFrame:
    """The last ``value`` that is not null at or before each row; the first at or behind it, if ``back``."""
    valued = df.withColumn("_value", value)
    known = F.struct(F.col("_value").alias("v"))
    first = F.min_by if back else F.max_by
    return _scan(
        valued, keys, order, name, slice_rows,
        local=lambda w, ties: F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        summary=lambda ties: F.when(F.count("_value") > 0, first(known, F.when(F.col("_value").isNotNull(), F.struct(*ties))))["v"],
        combine=lambda c: F.last(c, ignorenulls=True),
        merge=lambda own, carry: F.coalesce(own, carry),
        back=back,
    ).drop("_value")


# --- first free place --------------------------------------------------------------------


def _thresholds(limits: list[int]) -> list[int]:
    """Sorted numbers ``t`` such that a count ``c`` before these places is ``c + #(t > c)`` behind them."""
    out: list[int] = []
    open_ = 0
    for x in limits:
        if x >= ANYONE:
            open_ += 1
            continue
        # The least count before the first place that has reached x here: one for each of its thresholds above it.
        low, high = 0, len(out)
        while low < high:
            k = (low + high) // 2
            if out[k] + len(out) - k - 1 + open_ < x:
                low = k + 1
            else:
                high = k
        edge = x - (len(out) - low) - open_
        if edge > 0:
            out.insert(low, edge)
    return out + [ANYONE] * open_


def _runs(batches, keys: list[str]):
    """Rows of each key, a batch at a time: (key, whether it begins here, batch, first row, end)."""
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        low = 0
        while low < len(names):
            high = low + 1
            while high < len(names) and names[high] == names[low]:
                high += 1
            yield names[low], names[low] != last, batch, low, high
            last, low = names[low], high


def first_free(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: str, name: str, slice_rows: int | None = None) -> DataFrame:
    """Places in order, each taken by the next in a queue, if its number in the queue, from 0, is below the place's ``limit``.

    ``name`` is the number of the one who takes the place, null if nobody may; a null limit lets anyone in.  So each in the
    queue has the first place that is free and open to it.  The steps ``c -> c + (c < limit)`` of a slice
    make one staircase, kept as its sorted edges: slices are summed up on their own, a pass over the
    staircases of a key counts what is taken before each slice, and slices are settled on their own again.
    """
    keys, order = list(keys), list(order)
    cut = _sliced(df, keys, _order_columns(order), FREE_ROWS if slice_rows is None else slice_rows)
    rows = cut.rows.withColumn("_limit", F.coalesce(F.col(limit).cast("long"), F.lit(ANYONE)))
    unit = [*keys, _SLICE]
    if cut.hot is not None:
        edges = _staircases(rows.filter(F.col(_SLICE).isNotNull()), unit, cut.ties)
        before = _taken_before(edges, keys)
        same = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in unit]
        rows = rows.join(F.broadcast(before), same, "left").drop(*[f"_c_{k}" for k in unit])
    else:
        rows = rows.withColumn("_before", F.lit(0).cast("long"))
    dealt = rows.withColumn("_before", F.coalesce("_before", F.lit(0))).repartition(*unit).sortWithinPartitions(*unit, *cut.ties)
    kept = [f for f in dealt.schema.fields if f.name not in ("_limit", "_before", _SLICE, *cut.ties, name)]

    def settle(batches):
        taken = 0
        held: pa.RecordBatch | None = None
        numbers: list[int | None] = []
        for _, fresh, batch, low, high in _runs(batches, unit):
            if batch is not held:
                if held is not None:
                    yield done(held, numbers)
                held, numbers = batch, []
            if fresh:
                taken = batch.column("_before")[low].as_py()
            for x in batch.column("_limit").slice(low, high - low).to_pylist():
                numbers.append(taken if taken < x else None)
                taken += taken < x
        if held is not None:
            yield done(held, numbers)

    def done(batch: pa.RecordBatch, numbers: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(numbers, pa.int64())], [*(f.name for f in kept), name])

    return dealt.mapInArrow(settle, T.StructType([*kept, T.StructField(name, T.LongType())]))


def _staircases(rows: DataFrame, unit: list[str], ties: list[str]) -> DataFrame:
    """(unit, _edges): the staircase of each slice, eight bytes an edge."""
    kinds = T.StructType([*[rows.schema[k] for k in unit], T.StructField("_edges", T.BinaryType())])

    def summed(part: pa.Table) -> pa.Table:
        part = part.sort_by([(t, "ascending") for t in ties])
        edges = np.array(_thresholds(part.column("_limit").to_pylist()), np.int64)
        return pa.table({**{k: part.column(k).slice(0, 1) for k in unit}, "_edges": pa.array([edges.tobytes()], pa.binary())})

    return cut_lineage(rows.select(*unit, *ties, "_limit").groupBy(*unit).applyInArrow(summed, kinds))


def _taken_before(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Places taken before each slice of a key, read slice by slice."""
    unit = [*keys, _SLICE]
    kinds = T.StructType([*[T.StructField(f"_c_{k}", edges.schema[k].dataType) for k in unit], T.StructField("_before", T.LongType())])

    def walk(batches):
        taken = 0
        for _, fresh, batch, low, high in _runs(batches, keys):
            counts = []
            taken = 0 if fresh else taken
            for raw in batch.column("_edges").slice(low, high - low).to_pylist():
                counts.append(taken)
                found = np.frombuffer(raw, np.int64)
                taken += len(found) - int(np.searchsorted(found, taken, "right"))
            own = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in unit), pa.array(counts, pa.int64())], [*(f"_c_{k}" for k in unit), "_before"])

    return edges.repartition(*keys).sortWithinPartitions(*unit).mapInArrow(walk, kinds)
