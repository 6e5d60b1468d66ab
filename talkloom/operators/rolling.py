"""Trailing totals per entity and day, kept as a versioned state in parts of a day.

The totals of a day are yesterday's totals plus today's arrivals minus the amounts that leave the period.
``advance`` takes a state on by one day, or by a run of days at once; ``correct`` gives new rows of the dates
that late amounts touch. ``State`` keeps one folder a day and version; a reader opens the newest of each day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.sources.store import VersionedTable

WINDOWS = (7, 30)


def _totals(windows: Sequence[int]) -> list[str]:
    return [f"total_{w}" for w in windows]


def daily_amounts(rows: DataFrame, entity: str, day: str, amount) -> DataFrame:
    """(entity, day, amount): the sum per day, combined before the shuffle. Null entities or days are dropped."""
    return rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(amount.alias("amount"))


def advance(yesterday: DataFrame, expiring: DataFrame, arrivals: DataFrame, first: dt.date, last: dt.date | None = None, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(entity, day, amount, total_w...) of the days ``first`` to ``last`` (one day if not given).

    ``yesterday`` are the state's rows of the day before ``first``, ``expiring`` its rows of the days that leave a
    period within the run (others are ignored), ``arrivals`` is (entity, day, amount). The three are joined on entity
    and day by one aggregation of their union: yesterday's totals open the run, an arrival adds on its own day and
    takes off w days later, an expiring amount takes off. Their running sum within the run is the total. So each input
    is shuffled once, and no window is longer than the run. An entity goes on, with amount 0, until its longest
    period is empty; after that it has no rows until amounts arrive again.
    """
    last = last or first
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    zero = F.lit(0).cast("long")

    def events(rows: DataFrame, own: bool) -> DataFrame:
        """A row of ``rows`` as what it changes: on its own day, if wanted, and at the end of each period."""
        each = [(0, F.col("amount"), lambda w: F.col("amount"))] if own else []
        each += [(x, zero, lambda w, x=x: -F.col("amount") if w == x else zero) for x in windows]
        made = [F.struct(F.date_add("day", k).alias("day"), n.alias("amount"), *(net(w).alias(f"c_{w}") for w in windows)) for k, n, net in each]
        return rows.where("amount <> 0").select("entity", F.explode(F.array(*made)).alias("e")).select("entity", "e.*")

    opening = yesterday.select("entity", a.alias("day"), zero.alias("amount"), *(F.col(f"total_{w}").alias(f"c_{w}") for w in windows))
    changes = opening.unionByName(events(expiring, False)).unionByName(events(arrivals, True)).where(F.col("day").between(a, b))
    merged = changes.groupBy("entity", "day").agg(F.sum("amount").alias("amount"), *(F.sum(f"c_{w}").alias(f"c_{w}") for w in windows))
    order = Window.partitionBy("entity").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = merged.select(
        "entity", "day", "amount", *(F.sum(f"c_{w}").over(so_far).alias(f"total_{w}") for w in windows), F.date_sub(F.coalesce(F.lead("day").over(order), F.date_add(b, 1)), 1).alias("until")
    )
    known = reduce(lambda x, y: x | y, (F.col(c) != 0 for c in ["amount", *_totals(windows)]))
    days = running.where(known).select("entity", F.posexplode(F.sequence("day", "until")).alias("k", "day"), "amount", *_totals(windows))
    return days.select("entity", "day", F.when(F.col("k") == 0, F.col("amount")).otherwise(zero).alias("amount"), *_totals(windows))


def late_changes(late: DataFrame, end: dt.date, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(entity, day, amount, total_w...): what late amounts (entity, day, amount) add to each row of the days on which
    they count, up to the state's last day ``end``."""
    spread = late.select("entity", "amount", F.posexplode(F.sequence("day", F.date_add("day", max(windows) - 1))).alias("age", "day"))
    share = lambda w: F.coalesce(F.sum(F.when(F.col("age") < w, F.col("amount"))), F.lit(0)).cast("long")
    return spread.where(F.col("day") <= F.lit(end).cast("date")).groupBy("entity", "day").agg(share(1).alias("amount"), *(share(w).alias(f"total_{w}") for w in windows))


def correct(state: DataFrame, changes: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """``state`` (the rows of the touched days) with ``changes`` added; entities unknown on a day come in."""
    zero = F.lit(0).cast("long")
    columns = ["amount", *_totals(windows)]
    joined = state.join(changes.withColumnsRenamed({c: f"d_{c}" for c in columns}), ["entity", "day"], "full")
    return joined.select("entity", "day", *((F.coalesce(c, zero) + F.coalesce(f"d_{c}", zero)).alias(c) for c in columns))


def filled(state: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Every day from an entity's first to its last amount: days of which the state has no row get zeros, rows
    behind the last amount go. One shuffle by entity; a window has one row a day."""
    order = Window.partitionBy("entity").orderBy("day")
    last = F.max(F.when(F.col("amount") != 0, F.col("day"))).over(Window.partitionBy("entity"))
    rows = state.withColumns({"last": last, "next": F.lead("day").over(order)}).where("day <= last")
    until = F.when(F.col("day") == F.col("last"), F.col("day")).otherwise(F.date_sub("next", 1))
    values = ["amount", *_totals(windows)]
    days = rows.select("entity", F.posexplode(F.sequence("day", until)).alias("k", "day"), *values)
    return days.select("entity", "day", *(F.when(F.col("k") == 0, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in values))


class State:
    """The rolling state below one folder, in parts of ``span`` days, one by default. Every commit is a version; a part
    that is corrected gets a new folder beside its old one, and readers open the newest of each part, without any
    join of versions. Longer spans suit histories that are taken in at once."""

    def __init__(self, spark: SparkSession, folder: str, windows: Sequence[int] = WINDOWS, span: int = 1):
        self.windows, self.span = tuple(sorted(windows)), span
        schema = ", ".join(["entity long, day date, amount long", *(f"{t} long" for t in _totals(self.windows))])
        start = F.date_sub("day", F.pmod(F.unix_date("day"), F.lit(span)))
        self.table = VersionedTable(spark, folder, schema, by=start)

    def start(self, day: dt.date) -> dt.date:
        """First day of the part that ``day`` is in."""
        return day - dt.timedelta((day - dt.date(1970, 1, 1)).days % self.span)

    def days(self, version: int | None = None) -> list[dt.date]:
        """First days of all parts."""
        return sorted(map(dt.date.fromisoformat, self.table.parts(version)))

    def read(self, days: Sequence[dt.date] | None = None, version: int | None = None) -> DataFrame:
        """The newest rows; with ``days``, of the parts in which these lie."""
        return self.table.read(version, None if days is None else {self.start(d).isoformat() for d in days})

    def needed(self, first: dt.date, last: dt.date) -> list[dt.date]:
        """The days before the run of which amounts leave a period from ``first`` to ``last``."""
        run = (last - first).days + 1
        return sorted({first + dt.timedelta(k - w) for w in self.windows for k in range(run) if k < w})

    def advance(self, arrivals: DataFrame, first: dt.date, last: dt.date | None = None) -> int:
        """Commits the days ``first`` to ``last``, whole parts, from the state of the day before. Of the state only the
        day before and the days that expire are opened: three folders for one day and two windows. ``arrivals``
        (entity, day, amount; nulls and other days are ignored) must have one row per entity and day."""
        last = last or first
        if self.start(first) != first or self.start(last + dt.timedelta(1)) != last + dt.timedelta(1):
            raise ValueError(f"{first} to {last} are no whole parts of {self.span} days")
        mine = arrivals.where(F.col("entity").isNotNull() & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("amount").isNotNull())
        before = first - dt.timedelta(1)
        yesterday = self.read([before]).where(F.col("day") == F.lit(before).cast("date"))
        rows = advance(yesterday, self.read(self.needed(first, last)), mine, first, last, self.windows)
        return self.table.commit(rows, only=[(first + dt.timedelta(k)).isoformat() for k in range(0, (last - first).days + 1, self.span)])

    def correct(self, late: DataFrame, end: dt.date) -> int:
        """Commits new versions of the parts that ``late`` (entity, day, amount) touches, up to ``end``; others stay."""
        changes = late_changes(late, end, self.windows)
        return self.table.merge(changes, lambda rows, new: correct(rows, new, self.windows))


def rolling_state(spark: SparkSession, daily: DataFrame, folder: str, windows: Sequence[int] = WINDOWS, run: int = 30) -> DataFrame:
    """Every day of every entity from ``daily`` (entity, day, on_time, late), by way of a state in ``folder``.

    The state is taken on ``run`` days at a time by the amounts that came on their day; then the dates that late
    amounts touch are corrected. Each run is one job over its own days, so their number follows the length of the
    history and not its size. Amounts may not be negative; rows without entity or day are left out.
    """
    state = State(spark, folder, windows, run)
    daily = daily.where("entity is not null and day is not null")
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span.a is None:
        return filled(state.read(), windows)
    known = daily.where("on_time > 0").select("entity", "day", F.col("on_time").alias("amount"))
    first = state.start(span.a)
    while first <= span.b:
        last = first + dt.timedelta(run - 1)
        state.advance(known, first, last)
        first = last + dt.timedelta(1)
    state.correct(daily.where("late > 0").select("entity", "day", F.col("late").alias("amount")), last)
    return filled(state.read(), windows)
