"""Time steps: calendar offsets and fixed durations, axes, overlaps."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of fixed durations, and months of calendar offsets.
FIXED = {"s": 1, "min": 60, "T": 60, "h": 3600, "H": 3600, "D": 86400, "d": 86400, "W": 604800, "w": 604800}
CALENDAR = {"MS": 1, "M": 1, "m": 1, "QS": 3, "YS": 12, "AS": 12, "Y": 12, "A": 12, "y": 12}


@dataclass(frozen=True)
class Step:
    """So many months or so many seconds."""

    months: int = 0
    seconds: int = 0

    @property
    def interval(self) -> str:
        return f"interval {self.months} months" if self.months else f"interval {self.seconds} seconds"

    def __mul__(self, n: int) -> Step:
        return Step(self.months * n, self.seconds * n)

    def ratio(self, other: Step) -> float:
        if bool(self.months) != bool(other.months):
            raise ValueError("steps of months and of seconds have no fixed ratio")
        return self.months / other.months if self.months else self.seconds / other.seconds


def step(text: str) -> Step:
    got = re.fullmatch(r"(\d*)([A-Za-z]+)", text)
    if not got or got[2] not in FIXED | CALENDAR:
        raise ValueError(f"unknown time step: {text}")
    n = int(got[1] or 1)
    return Step(months=n * CALENDAR[got[2]]) if got[2] in CALENDAR else Step(seconds=n * FIXED[got[2]])


def add(time: Column, by: Step, n: Column | int = 1) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    if by.months:
        return F.timestamp_micros(F.unix_micros(F.add_months(F.date_trunc("day", time), n * by.months).cast("timestamp")) + F.unix_micros(time) - F.unix_micros(F.date_trunc("day", time)))
    return F.timestamp_micros(F.unix_micros(time) + n.cast("long") * by.seconds * 1_000_000)


def axis(spark: SparkSession, start: str, end: str, by: Step) -> DataFrame:
    """Half-open axis: itim, t0, t1 (not beyond the end), dt in seconds."""
    bounds = spark.sql(f"select timestamp '{start}' as a, timestamp '{end}' as b")
    steps = bounds.select("b", F.explode(F.expr(f"sequence(a, b, {by.interval})")).alias("t0")).filter("t0 < b")
    t1 = F.least(add(F.col("t0"), by), F.col("b"))
    order = (F.unix_micros("t0")).alias("at")
    numbered = steps.select("t0", t1.alias("t1"), order).selectExpr("t0", "t1", "row_number() over (order by at) - 1 as itim")
    return numbered.select("itim", "t0", "t1", seconds_between(F.col("t0"), F.col("t1")).alias("dt"))


def later(time: datetime, by: Step, n: int = 1) -> datetime:
    """A time so many steps on; beyond a month's end its last day."""
    if not by.months:
        return time + timedelta(seconds=n * by.seconds)
    year, month = divmod(time.year * 12 + time.month - 1 + n * by.months, 12)
    return time.replace(year=year, month=month + 1, day=min(time.day, monthrange(year, month + 1)[1]))


def spun(start: str, end: str, up: Step, down: Step) -> tuple[str, str]:
    """A period with spin-up before and spin-down after it."""
    return str(later(datetime.fromisoformat(start), up, -1)), str(later(datetime.fromisoformat(end), down))


def anchored(spark: SparkSession, start: str, end: str, by: Step, cover: bool = False) -> DataFrame:
    """Whole steps within a period, counted from 1 January of its first year, so that periods of one year share their steps.

    The first begins at or after the period's start, what lies before has none; with `cover`, it is the one that the start lies in.
    """
    begin = datetime.fromisoformat(start)
    first = january = datetime(begin.year, 1, 1)
    n = 0
    while first < begin:
        n += 1
        first = later(january, by, n)
    if cover and first > begin:
        first = later(january, by, n - 1)
    return axis(spark, str(first), end, by).filter(add(F.col("t0"), by) <= F.lit(end).cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)).cast("double") / F.lit(1e6)


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The share of [a0, a1) that [b0, b1) covers."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / (a1 - a0)
