"""Current stock, trailing pace, last activity and status of every SKU in the latest report.

Pace and activity come from one aggregation by SKU over the wider of their two windows, so a history of many
reports is shuffled once, by ``sku``, after map-side partial sums; the joins that follow reuse that distribution.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import status
from ..thresholds import LOOKBACK_FLOOR, Thresholds
from .reports import Scope


def cutoff(scope: Scope, limits: Thresholds):
    return scope.latest_end - timedelta(days=max(limits.dead_stock_days, LOOKBACK_FLOOR))


def current_snapshot(history: DataFrame, scope: Scope) -> DataFrame:
    return history.filter(F.col("report_id") == scope.latest_id).select("brand", "sku", "closing_stock", "value")


def pace() -> list:
    """Opening stock and movements of the rows that are ``trailing``."""
    total = lambda c: F.sum(F.when(F.col("trailing"), c)).alias
    order = F.when(F.col("trailing"), F.struct("period_end", "period_start"))
    return [
        F.min_by("opening_stock", order).alias("trailing_opening"),
        total(F.col("purchase") + F.col("purchase_free") + F.col("other_receipt"))("trailing_purchase"),
        total(F.col("sales"))("trailing_sales"),
        total(F.col("sales_free"))("trailing_sales_free"),
        total(F.col("other_issue"))("trailing_other_issue"),
    ]


def _activity(since) -> list:
    recent = F.col("period_end") >= F.lit(since)
    return [
        F.max(F.when(recent & (F.col("purchase") > 0), F.col("period_end"))).alias("last_purchase"),
        F.max(F.when(recent & ((F.col("sales") > 0) | (F.col("sales_free") > 0)), F.col("period_end"))).alias("last_sale"),
    ]


def trailing_totals(history: DataFrame, scope: Scope) -> DataFrame:
    """Opening stock and movements of every SKU within the trailing window."""
    rows = history.filter(F.col("report_id").isin(*scope.trailing_ids)).withColumn("trailing", F.lit(True))
    return rows.groupBy("sku").agg(*pace())


def _aged(rows: DataFrame, scope: Scope, limits: Thresholds) -> DataFrame:
    since = cutoff(scope, limits)
    last = F.coalesce(F.greatest("last_purchase", "last_sale"), F.lit(max(since, scope.first_start)))
    rows = rows.withColumn("last_activity", last).withColumn("days_since_activity", F.datediff(F.lit(scope.latest_end), "last_activity"))
    return rows.withColumn("is_dead", F.col("days_since_activity") >= limits.dead_stock_days)


def last_activity(history: DataFrame, scope: Scope, limits: Thresholds) -> DataFrame:
    """Dead-stock facts of the current SKUs: paid purchases and any sales count; free receipts do not."""
    since = cutoff(scope, limits)
    found = history.filter(F.col("period_end") >= F.lit(since)).groupBy("sku").agg(*_activity(since))
    rows = current_snapshot(history, scope).select("sku").join(found, "sku", "left")
    return _aged(rows, scope, limits).select("sku", "last_activity", "days_since_activity", "is_dead")


def enriched(history: DataFrame, scope: Scope, limits: Thresholds) -> DataFrame:
    """One row for each SKU of the latest report; ``days_of_cover`` is endless without demand."""
    since = cutoff(scope, limits)
    trailing = F.col("report_id").isin(*scope.trailing_ids)
    rows = history.withColumn("trailing", trailing).filter(F.col("trailing") | (F.col("period_end") >= F.lit(since)))
    return with_facts(current_snapshot(history, scope), rows.groupBy("sku").agg(*pace(), *_activity(since)), scope, limits)


def with_facts(snapshot: DataFrame, facts: DataFrame, scope: Scope, limits: Thresholds) -> DataFrame:
    """The current SKUs with what ``facts`` say of their pace and activity."""
    out = snapshot.join(facts, "sku", "left")
    out = out.fillna(0.0, ["trailing_opening", "trailing_purchase", "trailing_sales", "trailing_sales_free", "trailing_other_issue"])
    out = _aged(out, scope, limits)
    demand = F.col("trailing_sales") + F.col("trailing_sales_free")
    out = out.withColumn("daily_demand", demand / F.lit(float(scope.trailing_days)))
    out = out.withColumn("days_of_cover", F.when(F.col("daily_demand") > 0, F.col("closing_stock") / F.col("daily_demand")).otherwise(F.lit(float("inf"))))
    out = out.withColumn("is_returned", (demand == 0) & (F.col("trailing_other_issue") > 0))
    out = out.withColumn("status", status(limits.low_stock_days, limits.overstock_days))
    return out.select(
        "sku", "brand", "closing_stock", "value", "trailing_opening", "trailing_purchase", "trailing_sales", "trailing_sales_free", "trailing_other_issue",
        "daily_demand", "days_of_cover", "last_activity", "days_since_activity", "is_dead", "is_returned", "status",
    )
