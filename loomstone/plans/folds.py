"""Greedy groups of consecutive rows, by a fold that can be cut.

A group takes rows until their sizes reach a target, so where one ends depends
on where the one before ended, back to the first row. But all that enters a
row is how much is open. So a group's rows are cut into segments, and each
segment reports, for every amount that may enter it, what leaves it: a short
table, as amounts at and above what the segment needs to close a group differ
no further. The tables are put together along the rows, one row a segment,
and each segment then runs once from the amount that really enters it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.ordered import SEGMENT, position_bucket

CLOSED = -(1 << 63)  # stands for the first position of no group


def moves(positions: Sequence[int], sizes: Sequence[int], target: int) -> dict:
    """What a segment does with an open amount below the target.

    The first i with need[i] <= amount says what leaves: left[i], open since
    position since[i], or nothing open where that is CLOSED. Where there is
    none, no group closes here, and ``total`` is added to the amount.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    count = len(ends)
    close = np.searchsorted(ends, starts + target)  # the row at which a group that begins here closes
    left, since = np.zeros(count + 1, np.int64), np.full(count + 1, CLOSED, np.int64)
    for i in range(count - 1, -1, -1):
        done = close[i] < count
        left[i] = left[close[i] + 1] if done else ends[-1] - starts[i]
        since[i] = since[close[i] + 1] if done else positions[i]
    need, first = np.unique(-np.maximum(target - ends, 0), return_index=True)  # rising -need: falling need, the first row of each
    keep = -need < target
    return {"need": (-need[keep]).tolist(), "left": left[first[keep] + 1].tolist(), "since": since[first[keep] + 1].tolist(), "total": int(ends[-1])}


def _moves_udf():
    @F.pandas_udf("struct<need:array<long>,left:array<long>,since:array<long>,total:long>")
    def of(positions: pd.Series, sizes: pd.Series, targets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([moves(p, n, int(t)) for p, n, t in zip(positions, sizes, targets)], columns=["need", "left", "since", "total"])

    return of


def _entering(keys: Sequence[str]):
    """Segments sorted along their group -> what is open where each begins, and since which position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, amount, since = None, 0, CLOSED
        for batch in batches:
            opens, begun = [], []
            columns = [batch.column(c).to_pylist() for c in (*keys, "_head", "_moves")]
            for *key, head, move in zip(*columns):
                if key != at:
                    at, amount, since = key, 0, CLOSED
                opens.append(amount)
                begun.append(since)
                step = next((i for i, n in enumerate(move["need"]) if n <= amount), None)
                if step is not None:
                    amount, since = move["left"][step], move["since"][step]
                else:
                    amount, since = amount + move["total"], head if since == CLOSED else since
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*keys, "_seg")), pa.array(opens, pa.int64()), pa.array(begun, pa.int64())], [*keys, "_seg", "_amount", "_since"]
            )

    return run


def grouped(positions: Sequence[int], sizes: Sequence[int], target: int, amount: int, since: int) -> list[int]:
    """For each row of a segment the first position of its group."""
    out = []
    for position, size in zip(positions, sizes):
        since = position if since == CLOSED else since
        out.append(since)
        amount += size
        if amount >= target:
            amount, since = 0, CLOSED
    return out


def _grouped_udf():
    @F.pandas_udf("array<long>")
    def of(positions: pd.Series, sizes: pd.Series, targets: pd.Series, amounts: pd.Series, begun: pd.Series) -> pd.Series:
        return pd.Series([grouped(p.tolist(), n.tolist(), int(t), int(a), int(s)) for p, n, t, a, s in zip(positions, sizes, targets, amounts, begun)])

    return of


def size_groups(rows: DataFrame, keys: Sequence[str], position: str, size: str, target: str, segment: int = SEGMENT) -> DataFrame:
    """(keys, position, size, first): rows of one key go together, by position, until their sizes reach ``target``; first is their first position.

    Positions are whole numbers, unique in a key, sizes are 0 or more, and a
    key has one target above 0. Only these numbers travel. A row of the plan
    holds the sizes of one segment of ``segment`` positions, or a table with
    fewer entries than that and than the target; the tables of one key pass one
    task, a row at a time.
    """
    keys = list(keys)
    unit = F.struct(F.col(position).cast("long").alias("at"), F.col(size).cast("long").alias("n"))
    segments = rows.withColumn("_seg", position_bucket(position, segment)).groupBy(*keys, "_seg").agg(F.first(target).alias("_target"), F.array_sort(F.collect_list(unit)).alias("_units"))
    at, n = F.col("_units")["at"], F.col("_units")["n"]
    tables = segments.select(*keys, "_seg", at[0].alias("_head"), _moves_udf()(at, n, F.col("_target")).alias("_moves"))
    kinds = ", ".join(f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in (*keys, "_seg"))
    entries = tables.repartition(*keys).sortWithinPartitions(*keys, "_seg").mapInArrow(_entering(keys), f"{kinds}, _amount long, _since long")
    met = segments.join(entries, [*keys, "_seg"])
    met = met.withColumn("_first", _grouped_udf()(at, n, F.col("_target"), F.col("_amount"), F.col("_since")))
    one = met.select(*keys, F.explode(F.arrays_zip("_units", "_first")).alias("_u"))
    return one.select(*keys, F.col("_u._units.at").alias(position), F.col("_u._units.n").alias(size), F.col("_u._first").alias("first"))
