"""Ordered-list operators: budgets, headers, first occurrences, ranks, shares, windows around an anchor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators.merge import ranked


def take_budget(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], size: Column, budget: float, most: int) -> DataFrame:
    """Of each group the first rows while the sizes before and including them stay below ``budget`` and they are fewer than ``most``.

    The bound on the count is applied first, where the rows are, so a large group sends few of them.
    """
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_k") < most)
    along = Window.partitionBy(*groups).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return few.withColumn("_sum", F.sum(size).over(along)).where(F.col("_sum") < budget).drop("_sum", "_k")


def month_headers(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], month: Column) -> DataFrame:
    """``rows`` with month and header: whether the next row of the group is of another month, or there is none.

    ``order`` must be by time, so that the months of a group follow each other: then the last row of each month
    is the header, and no window is larger than a month.
    """
    w = Window.partitionBy(*groups, "month").orderBy(*order)
    return rows.withColumn("month", month).withColumn("header", F.lead(F.lit(1)).over(w).isNull())


def in_order(rows: DataFrame, *order: Column | str, position: str = "position") -> DataFrame:
    """``rows`` with their 1-based position in ``order``, which should be total; no task sees all rows."""
    return ranked(rows, position, order).withColumn(position, (F.col(position) + 1).cast("long"))


def first_occurrence(rows: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The row of each key that comes first; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*position, F.xxhash64(*rest))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def share_of_total(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (an aggregate of few rows) with their share of the sum; 0 where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy())
    return rows.withColumn("share", F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col(value) / total, 6)))


def raise_small(rows: DataFrame, value: str, least: float) -> DataFrame:
    """``rows`` (few) with drawn: positive values below ``least`` of the total raised to it, what was added taken evenly
    (whole division by all rows) from every positive one."""
    w = Window.partitionBy()
    minimum = F.floor(F.sum(value).over(w) * least)
    raised = F.when((F.col(value) > 0) & (F.col(value) < minimum), minimum).otherwise(F.col(value))
    out = rows.withColumn("_raised", raised.cast("long"))
    minus = F.floor(F.sum(F.col("_raised") - F.col(value)).over(w) / F.count("*").over(w))
    return out.withColumn("drawn", F.when(F.col("_raised") > 0, F.col("_raised") - minus).otherwise(F.col("_raised")).cast("long")).drop("_raised")


def top_and_more(rows: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    """The first ``n`` rows, each with more: how many are left out."""
    total = rows.count()
    return rows.orderBy(*order).limit(n).withColumn("more", F.lit(max(0, total - n)).cast("long"))


def around(rows: DataFrame, order: str, tie: str, anchor: tuple, before: int, after: int) -> DataFrame:
    """The rows around an anchor (order, tie): ``before`` that precede it and ``after`` from it on, by two bounded sorts."""
    at, t = anchor
    earlier = (F.col(order) < at) | ((F.col(order) == at) & (F.col(tie) < t))
    return rows.where(earlier).orderBy(F.col(order).desc(), F.col(tie).desc()).limit(before).unionByName(rows.where(~earlier).orderBy(order, tie).limit(after))


def sliding_count(rows: DataFrame, groups: Sequence[str], seconds: str, width: int) -> DataFrame:
    """``rows`` with recent: rows of the group in the ``width`` seconds up to and including each.

    Groups are cut into spans of that width; each row counts in its own span and, as context, in the next, so a
    large group is many windows. Null times count nothing and get 0.
    """
    span = F.floor(F.col(seconds) / width)
    placed = rows.withColumn("_own", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_span", span + F.col("_own"))
    w = Window.partitionBy(*groups, "_span").orderBy(seconds).rangeBetween(-width, 0)
    counted = placed.where(F.col(seconds).isNotNull()).withColumn("recent", F.count("*").over(w))
    none = placed.where(F.col(seconds).isNull()).withColumn("recent", F.lit(0).cast("long"))
    return counted.unionByName(none).where("_own = 0").drop("_own", "_span")


def natural_key(text: Column) -> Column:
    """A sort key by which numbers in text sort by value: runs of digits padded with zeros."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def by_list(rows: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Rows in the order of ``ids``, ids without row kept."""
    wanted = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(ids)], f"position int, {key} long")
    return wanted.join(rows, key, "left")


def expand_groups(rows: DataFrame, selected: DataFrame, key: str, group: str) -> DataFrame:
    """Selected rows and all that share a non-null group with one of them, each once."""
    groups = rows.join(selected.select(key), key, "left_semi").where(F.col(group).isNotNull()).select(group).distinct()
    return rows.join(selected.select(key), key, "left_semi").unionByName(rows.join(groups, group, "left_semi").select(*rows.columns)).distinct()


def changes_only(rows: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, span: Column) -> DataFrame:
    """Rows whose value differs from the one before (nulls equal each other); the first of a group always.

    ``span`` cuts a group into parts along ``order`` (such as days); each part is a window of its own, and of the
    parts before it only the last value is needed.
    """
    parts = rows.withColumn("_span", span)
    last = parts.groupBy(*groups, "_span").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*groups).orderBy("_span"))).drop("_last")
    w = Window.partitionBy(*groups, "_span").orderBy(*order)
    joined = parts.withColumn("_lag", F.lag(F.struct(value)).over(w)).join(before, [*groups, "_span"])
    previous = F.coalesce("_lag", "_before")
    return joined.where(previous.isNull() | ~previous[value].eqNullSafe(F.col(value))).select(*rows.columns)
