"""Partial sums by SKU and month, from which pace and activity of any window come without the rows behind them.

Sums add up, first openings and last dates are minima and maxima, so months can be put together in any way. A month is recomputed from its
own rows alone when one of its reports comes, changes or goes; no other month's rows are read. A window that begins within a month takes that
month's reports from the rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders
from ..thresholds import Thresholds
from .enriched import current_snapshot, cutoff, with_facts
from .reports import Scope

SUMS = "sku string, first long, opening double, purchase double, sales double, sales_free double, other_issue double, last_purchase date, last_sale date, month date"
_TOTALS = ("purchase", "sales", "sales_free", "other_issue")
#: How many rows a task that makes sums gets, about, and how many a file of sums has at most, as a task that reads them takes several files.
RANGE_ROWS, FILE_ROWS = 1 << 19, 1 << 16


def month(day: str = "period_end") -> Column:
    return F.trunc(day, "month")


def _order() -> Column:
    """``(period_end, period_start)`` as one number, by end and then by start, nulls lowest: aggregates of numbers are hashed, those of structs sort all rows."""
    end, start = (F.coalesce(F.unix_date(c).cast("long"), F.lit(-(1 << 30))) for c in ("period_end", "period_start"))
    return end * (1 << 32) + start


def monthly(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """What each SKU did in each month: its first opening, sums of movements, and last paid purchase and sale.

    With ``ranges`` rows are cut into as many by month and SKU, and each is summed where it lies.
    """
    sold = (F.col("sales") > 0) | (F.col("sales_free") > 0)
    received = F.col("purchase") + F.col("purchase_free") + F.col("other_receipt")
    rows = rows.withColumn("month", month())
    if ranges is not None:
        rows = rows.repartitionByRange(ranges, "month", "sku")
    return rows.groupBy("sku", "month").agg(
        F.min(_order()).alias("first"),
        F.min_by("opening_stock", _order()).alias("opening"),
        F.sum(received).alias("purchase"),
        *[F.sum(c).alias(c) for c in ("sales", "sales_free", "other_issue")],
        F.max(F.when(F.col("purchase") > 0, F.col("period_end"))).alias("last_purchase"),
        F.max(F.when(sold, F.col("period_end"))).alias("last_sale"),
    )


def write_sums(history: DataFrame, path: str, months: list[date] | None = None) -> None:
    """Writes the sums of ``months`` (of all without it) anew; months whose reports have all gone are deleted.

    Writing a month again gives the same, so a lost run is simply repeated.
    """
    spark = history.sparkSession
    rows, mode = (history, "static") if months is None else (history.filter(_within(months)), "dynamic")
    held = dict(rows.groupBy(month()).count().collect())  # a row for each month
    for m in set(months or ()) - set(held):
        folders.delete(spark, f"{path}/month={m}")
    ranges = max(spark.sparkContext.defaultParallelism, -(-sum(held.values()) // RANGE_ROWS))
    made = monthly(rows, ranges).select([c.split()[0] for c in SUMS.split(", ")])
    made.write.mode("overwrite").option("partitionOverwriteMode", mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("month").parquet(path)


def _within(months: list[date]) -> Column:
    """Rows of these months, as ranges of ``period_end`` that prune partitions."""
    out = F.lit(False)
    for m in months:
        out = out | F.col("period_end").between(F.lit(m), F.last_day(F.lit(m)))
    return out


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMS).parquet(path)


def facts(sums: DataFrame, history: DataFrame, reports: DataFrame, scope: Scope, limits: Thresholds) -> DataFrame:
    """Pace and activity by SKU, as ``enriched`` has them from rows; of the history only the months at a window's edge are read.

    ``reports`` is the dimension, a row for each report.
    """
    since = cutoff(scope, limits)
    trailing = F.col("report_id").isin(*scope.trailing_ids)
    ends = reports.groupBy(month().alias("month")).agg(F.bool_and(trailing).alias("whole"), F.bool_or(trailing).alias("some")).collect()  # a row for each month
    whole = [r["month"] for r in ends if r["whole"]]
    edges = sorted({r["month"] for r in ends if r["some"] and not r["whole"]} | {since.replace(day=1)})
    recent = F.col("month") > F.lit(since)
    kept = sums.filter(recent | F.col("month").isin(*whole)).withColumns({"trailing": F.col("month").isin(*whole), "recent": recent})
    rows = history.filter(_within(edges)).withColumn("t", trailing & ~month().isin(*whole)).withColumn("r", (F.col("period_end") >= F.lit(since)) & ~(month() > F.lit(since)))
    sold, received = (F.col("sales") > 0) | (F.col("sales_free") > 0), F.col("purchase") + F.col("purchase_free") + F.col("other_receipt")
    edge = rows.filter("t or r").select(
        "sku",
        _order().alias("first"),
        F.col("opening_stock").alias("opening"),
        received.alias("purchase"),
        *("sales", "sales_free", "other_issue"),
        F.when(F.col("purchase") > 0, F.col("period_end")).alias("last_purchase"),
        F.when(sold, F.col("period_end")).alias("last_sale"),
        month().alias("month"),
        F.col("t").alias("trailing"),
        F.col("r").alias("recent"),
    )
    both = kept.unionByName(edge)
    own = lambda c: F.when(F.col("trailing"), F.col(c))
    late = lambda c: F.max(F.when(F.col("recent"), F.col(c))).alias(c)
    return both.groupBy("sku").agg(F.min_by("opening", own("first")).alias("trailing_opening"), *[F.sum(own(c)).alias(f"trailing_{c}") for c in _TOTALS], late("last_purchase"), late("last_sale"))


def enriched(sums: DataFrame, history: DataFrame, reports: DataFrame, scope: Scope, limits: Thresholds) -> DataFrame:
    """The enriched SKUs from partial sums: of the history the latest report and the months at the windows' edges are read."""
    return with_facts(current_snapshot(history, scope), facts(sums, history, reports, scope, limits), scope, limits)
