"""The report dimension: order, trailing window, gaps. One row for each report, so windows over it are small."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import fiscal_year, period_label

REPORT = ("report_id", "period_start", "period_end", "period_days", "company", "location")
#: The order that decides which report is latest; the later start wins among equal ends.
LATEST = ("period_end", "period_start")


def dimension(history: DataFrame) -> DataFrame:
    """Distinct reports of a history. Equal rows fall together by hash first, as a first value of text for each report would sort a task's rows."""
    first = Window.partitionBy("report_id").orderBy(*REPORT[1:])
    return history.select(*REPORT).distinct().withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def trailing_window(reports: DataFrame, target: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reports newest first with ``days_before`` and whether each is ``taken``: while the days before it are below the target.

    The report that crosses the target is taken. With ``keys`` every store has a window of its own.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in LATEST])
    before = F.coalesce(F.sum("period_days").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return reports.withColumn("days_before", before).withColumn("taken", F.col("days_before") < target)


@dataclass(frozen=True)
class Scope:
    """What the report dimension says, as literals that prune and push down."""

    latest_id: int
    latest_end: date
    previous_id: int | None
    previous_end: date | None
    first_start: date
    trailing_ids: tuple[int, ...]
    trailing_days: int


def scope(history: DataFrame, target: int) -> Scope | None:
    """Collects the dimension (one row for each report); None if there is no report."""
    rows = trailing_window(dimension(history), target).orderBy(*LATEST).collect()
    if not rows:
        return None
    taken = [r for r in rows if r["taken"]]
    before = rows[-2] if len(rows) > 1 else None
    return Scope(
        rows[-1]["report_id"],
        rows[-1]["period_end"],
        before and before["report_id"],
        before and before["period_end"],
        rows[0]["period_start"],
        tuple(r["report_id"] for r in taken),
        sum(r["period_days"] for r in taken),
    )


def per_store(history: DataFrame, build: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("company", "location")) -> DataFrame:
    """What ``build`` makes of each store's history, with the store's ``keys`` before its columns.

    For some tens of stores and results that ``stores`` has no keyed form of: their keys are collected, and the plan has a branch for each. Null keys are
    a store too.
    """
    out = None
    for store in history.select(*keys).distinct().orderBy(*keys).collect():
        own = history
        for k in keys:
            own = own.filter(F.col(k).eqNullSafe(F.lit(store[k])))
        rows = build(own)
        part = rows.select(*[F.lit(store[k]).cast("string").alias(k) for k in keys], *[c for c in rows.columns if c not in keys])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a history without rows has no stores")
    return out


def labels(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", "period_start", "period_end", period_label(F.col("period_start"), F.col("period_end")).alias("label"))


def by_fiscal_year(reports: DataFrame) -> DataFrame:
    """Reports for each fiscal year of their start, newest year first."""
    year = fiscal_year(F.col("period_start")).alias("fy")
    return reports.groupBy(year).agg(F.count("*").alias("reports"), F.min("period_start").alias("first_start"), F.max("period_end").alias("last_end")).orderBy(F.desc("fy"))


def listed_by_fiscal_year(reports: DataFrame) -> DataFrame:
    """Every report under its fiscal year: newest year first, within it by start; ``position`` counts within the year."""
    place = Window.partitionBy("fy").orderBy("period_start", "period_end")
    rows = reports.withColumn("fy", fiscal_year(F.col("period_start")))
    return rows.select("fy", F.row_number().over(place).alias("position"), "report_id", "period_start", "period_end").orderBy(F.desc("fy"), "position")


def history_meta(reports: DataFrame, target: int) -> DataFrame:
    """Company and place of the latest report, the first report's start, the latest end, count and trailing days."""
    order = F.struct(*LATEST)
    window = trailing_window(reports, target)
    return window.agg(
        F.max_by("company", order).alias("company"),
        F.max_by("location", order).alias("location"),
        F.min_by("period_start", order).alias("earliest_period_start"),
        F.max_by("period_end", order).alias("latest_period_end"),
        F.count("*").alias("report_count"),
        F.sum(F.when(F.col("taken"), F.col("period_days"))).alias("trailing_days"),
    )


def coverage_gaps(reports: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Days between the furthest end so far and the next start, of each store if there are ``keys``."""
    earlier = Window.partitionBy(*keys).orderBy("period_start", "period_end").rowsBetween(Window.unboundedPreceding, -1)
    reached = reports.select(*keys, "period_start", F.max("period_end").over(earlier).alias("reached"))
    gap = reached.filter(F.col("period_start") > F.date_add("reached", 1))
    return gap.select(*keys, F.date_add("reached", 1).alias("gap_start"), F.date_sub("period_start", 1).alias("gap_end")).withColumn("days", F.datediff("gap_end", "gap_start") + 1)


def trailing_gaps(reports: DataFrame, target: int) -> DataFrame:
    """Gaps between the reports of the trailing window only."""
    return coverage_gaps(trailing_window(reports, target).filter("taken"))


def missing_months(reports: DataFrame) -> DataFrame:
    """Months within the covered range that no report overlaps."""
    span = reports.agg(F.trunc(F.min("period_start"), "month").alias("a"), F.trunc(F.max("period_end"), "month").alias("b")).filter("a is not null")
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    held = reports.select(F.explode(F.sequence(F.trunc("period_start", "month"), F.trunc("period_end", "month"), F.expr("interval 1 month"))).alias("month"))
    return months.join(held.distinct(), "month", "left_anti").select("month", F.date_format("month", "MMM yyyy").alias("label"))
