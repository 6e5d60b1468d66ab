"""The N highest rows of every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same_as_previous(column: pa.Array) -> np.ndarray:
    """For each entry from the second on, whether it equals the one before it (nulls equal each other)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _first_of_runs(groups: Sequence[str], n: int):
    """Streams sorted batches and hands on the first ``n`` rows of each run; keeps one key and one count."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows - 1, bool)
            for g in groups:
                same &= _same_as_previous(batch.column(g))
            start = np.flatnonzero(np.r_[True, ~same])
            rank = np.arange(batch.num_rows) - np.repeat(start, np.diff(np.r_[start, batch.num_rows]))
            head = tuple(batch.column(g)[0].as_py() for g in groups)
            if head == last:
                end = start[1] if len(start) > 1 else batch.num_rows
                rank[:end] += seen
            last, seen = tuple(batch.column(g)[-1].as_py() for g in groups), int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return take


def top_n(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, which should end in a unique key.

    Rows are sorted within their partition by group and order and streamed in Arrow batches that pass on
    ``n`` rows per group; no group is ever buffered. This runs twice: first where the rows are, so that a
    group of any size leaves at most ``n`` rows per partition, then after hash partitioning by group.
    A null group is a group; fewer than ``n`` rows are all kept; equal rows count one by one; columns
    besides the named ones are carried along whatever their names. Empty input gives an empty result.
    """
    if n < 1:
        return rows.limit(0)
    sort = [*(F.col(f"`{g}`").asc_nulls_first() for g in groups), *order]
    take = _first_of_runs(list(groups), n)
    local = rows.sortWithinPartitions(*sort).mapInArrow(take, rows.schema)
    return local.repartition(*(F.col(f"`{g}`") for g in groups)).sortWithinPartitions(*sort).mapInArrow(take, rows.schema)
