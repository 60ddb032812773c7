"""Roll-ups, leaderboards, action lists and trends of the enriched SKUs and the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import AGES, STATUSES, literal_frame, period_label
from .reports import dimension

MONEY = "decimal(38,2)"
LIST = ("sku", "brand", "closing_stock", "value", "trailing_purchase", "trailing_sales", "days_of_cover", "status")


def _sum_value(name: str = "total_value"):
    return F.coalesce(F.sum("value"), F.lit(0)).cast(MONEY).alias(name)


def status_rollup(enriched: DataFrame) -> DataFrame:
    """Count and value of every status, in fixed order, zero where there is none."""
    fixed = literal_frame(enriched.sparkSession, {"position": "int", "status": "string"}, list(enumerate(STATUSES)))
    found = enriched.groupBy("status").agg(F.count("*").alias("n"), _sum_value("v"))
    out = fixed.join(F.broadcast(found), "status", "left")
    return out.select("position", "status", F.coalesce("n", F.lit(0)).alias("sku_count"), F.coalesce("v", F.lit(0)).cast(MONEY).alias("total_value")).orderBy("position")


def kpis(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count("*").alias("sku_count"), F.countDistinct("brand").alias("brand_count"), _sum_value(), F.coalesce(F.sum("closing_stock"), F.lit(0.0)).alias("total_closing"))


def top_brands(enriched: DataFrame, n: int = 10) -> DataFrame:
    return enriched.filter("brand is not null").groupBy("brand").agg(_sum_value()).orderBy(F.desc("total_value"), "brand").limit(n)


def top_skus(enriched: DataFrame, by: str, n: int = 15) -> DataFrame:
    """Leaders by ``value`` or by paid ``trailing_sales``."""
    return enriched.select("sku", "brand", "closing_stock", "value", "trailing_sales").orderBy(F.desc(by), "sku").limit(n)


def action_list(enriched: DataFrame, status: str) -> DataFrame:
    """The SKUs of one status, by value; low stock by cover; dead stock with its days without activity."""
    more = ("days_since_activity",) if status == "dead_stock" else ()
    order = "days_of_cover" if status == "low_stock" else "value"
    return enriched.filter(F.col("status") == status).select(*LIST, *more).orderBy(F.desc(order), "sku")


def dead_aging(enriched: DataFrame) -> DataFrame:
    """Dead stock by age, all ages present; younger dead stock is in none."""
    days = F.col("days_since_activity")
    age = F.lit(None).cast("string")
    for label, low, high in reversed(AGES):
        age = F.when((days >= low) & (F.lit(True) if high is None else days < high), label).otherwise(age)
    fixed = literal_frame(enriched.sparkSession, {"position": "int", "bucket": "string"}, [(i, a[0]) for i, a in enumerate(AGES)])
    found = enriched.filter("status = 'dead_stock'").groupBy(age.alias("bucket")).agg(F.count("*").alias("n"), _sum_value("v"))
    out = fixed.join(F.broadcast(found), "bucket", "left")
    return out.select("position", "bucket", F.coalesce("n", F.lit(0)).alias("sku_count"), F.coalesce("v", F.lit(0)).cast(MONEY).alias("total_value")).orderBy("position")


def trend(history: DataFrame) -> DataFrame:
    """Value and paid sales of every report, in report order."""
    sums = history.groupBy("report_id").agg(_sum_value(), F.sum("sales").alias("total_sales"))
    named = dimension(history).join(sums, "report_id")
    label = period_label(F.col("period_start"), F.col("period_end")).alias("label")
    return named.select("report_id", "period_start", "period_end", label, "total_value", "total_sales").orderBy("period_end", "period_start")


def trend_top_brands(history: DataFrame, enriched: DataFrame, n: int = 5) -> DataFrame:
    """Paid sales of the leading brands in every report, zero where a brand has none."""
    leaders = top_brands(enriched, n).select("brand")
    sums = history.join(F.broadcast(leaders), "brand", "left_semi").groupBy("brand", "report_id").agg(F.sum("sales").alias("s"))
    every = dimension(history).select("report_id").crossJoin(F.broadcast(leaders))
    return every.join(sums, ["brand", "report_id"], "left").select("brand", "report_id", F.coalesce("s", F.lit(0.0)).alias("total_sales"))
