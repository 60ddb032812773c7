"""Search, histories and details of SKUs and brands, and the table view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import Scope
from .rollups import MONEY


def sku_search(enriched: DataFrame, query: str, n: int = 50) -> DataFrame:
    """SKUs or brands that contain the query as it stands, without case; queries of fewer than two characters find nothing."""
    q = query.strip().lower()
    hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    rows = enriched.filter(hit(F.col("brand")) | hit(F.col("sku"))) if len(q) >= 2 else enriched.limit(0)
    return rows.select("sku", "brand", "closing_stock", "value", "status").orderBy(F.desc("value"), "sku").limit(n)


def sku_history(history: DataFrame, sku: str) -> DataFrame:
    """All reports of a SKU, under any brand, oldest first."""
    keep = ("report_id", "period_start", "period_end", "brand", "sku", "opening_stock", "purchase", "sales", "closing_stock", "value")
    return history.filter(F.col("sku") == sku).select(*keep).orderBy("period_end", "period_start")


def brand_history(history: DataFrame, brand: str) -> DataFrame:
    rows = history.filter(F.col("brand") == brand).groupBy("report_id", "period_start", "period_end")
    return rows.agg(F.sum("value").cast(MONEY).alias("total_value"), F.sum("sales").alias("total_sales")).orderBy("period_end", "period_start")


def sku_detail(enriched: DataFrame, segments: DataFrame, sku: str, brand: str | None = None) -> DataFrame:
    """The current row with its segment; the snapshot's brand, else the caller's."""
    row = enriched.filter(F.col("sku") == sku)
    found = row.join(segments.filter(F.col("sku") == sku).select("sku", "segment"), "sku", "left")
    return found.withColumn("brand", F.coalesce("brand", F.lit(brand).cast("string")))


def brand_detail(enriched: DataFrame, brand: str) -> tuple[DataFrame, DataFrame]:
    """The brand's current SKUs by value and its totals."""
    rows = enriched.filter(F.col("brand") == brand).select("sku", "brand", "closing_stock", "value", "status")
    totals = rows.agg(F.count("*").alias("sku_count"), F.sum("value").cast(MONEY).alias("total_value"), F.sum("closing_stock").alias("total_closing"))
    return rows.orderBy(F.desc("value"), "sku"), totals


def table_page(rows: DataFrame, text: str, by: str, ascending: bool, n: int = 300) -> DataFrame:
    """Rows whose SKU or brand contains the text, by any column, nulls at the end of either order, the first ``n``."""
    q = text.strip().lower()
    hit = F.coalesce(F.contains(F.lower("sku"), F.lit(q)), F.lit(False)) | F.coalesce(F.contains(F.lower("brand"), F.lit(q)), F.lit(False))
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return (rows.filter(hit) if q else rows).orderBy(order, "sku").limit(n)


def current(history: DataFrame, scope: Scope) -> DataFrame:
    return history.filter(F.col("report_id") == scope.latest_id)
