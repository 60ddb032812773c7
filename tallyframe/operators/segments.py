"""ABC value tiers and their cross with movement.

The cumulative share of value is a running sum over all SKUs, which one window would pull into one task. Values fall
into buckets by their logarithm, which keeps their order; bucket totals (some hundred numbers at most) are added up on
the driver, and each bucket has its own running sum on top of the total above it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import MOVEMENTS, PACES, TIERS, literal_frame
from ..thresholds import Thresholds
from .rollups import MONEY

# The advice for each cell, by tier and movement.
POLICIES = {
    ("A", "fast"): "Top priority — keep well stocked, review often.",
    ("A", "slow"): "High value moving slowly — review before reordering; consider a smaller order quantity.",
    ("A", "non_moving"): "High value tied up, not moving — review for return/markdown before it ages further.",
    ("B", "fast"): "Standard reorder cadence, no special attention needed.",
    ("B", "slow"): "Reduce reorder quantity; keep an eye on it.",
    ("B", "non_moving"): "Worth a look — candidate for markdown or return.",
    ("C", "fast"): "Low value, low risk — simplified reordering.",
    ("C", "slow"): "Low-value long tail — reorder only on request, minimal review.",
    ("C", "non_moving"): "Low-value dead stock — low priority, but a candidate to drop from the catalog.",
}


def bucket() -> Column:
    """A number that falls with the value, and the same for close values."""
    return F.when(F.col("value") > 0, F.floor(F.log2(F.col("value").cast("double")) * 8).cast("int")).otherwise(F.lit(-(2**20)))


def value_tiers(enriched: DataFrame, limits: Thresholds) -> DataFrame:
    """``sku, value, tier`` of stocked SKUs: A and B while the share before a SKU is below the cutoffs, else C.

    SKUs come by value descending and then name; if the total is not positive all are C.
    """
    stocked = enriched.filter("closing_stock > 0").select("sku", "value")
    stocked = stocked.withColumn("bucket", bucket())
    totals = {r["bucket"]: r["s"] for r in stocked.groupBy("bucket").agg(F.sum("value").cast(MONEY).alias("s")).collect()}
    above, before = Decimal(0), []
    for b in sorted(totals, reverse=True):
        before.append((b, above))
        above += totals[b]
    if not before:
        return stocked.select("sku", "value", F.lit("C").alias("tier"))
    fixed = literal_frame(enriched.sparkSession, {"bucket": "int", "above": MONEY}, [(b, str(a)) for b, a in before])
    inside = Window.partitionBy("bucket").orderBy(F.desc("value"), "sku").rowsBetween(Window.unboundedPreceding, -1)
    out = stocked.join(F.broadcast(fixed), "bucket").withColumn("before", F.col("above") + F.coalesce(F.sum("value").over(inside), F.lit(0)))
    total = F.lit(above).cast(MONEY)
    below = lambda pct: F.col("before") * 100 < total * pct
    tier = F.when(total <= 0, "C").when(below(limits.tier_a_pct), "A").when(below(limits.tier_b_pct), "B").otherwise("C")
    return out.select("sku", "value", tier.alias("tier"))


def value_segments(enriched: DataFrame, limits: Thresholds) -> DataFrame:
    """Stocked SKUs with tier, movement and segment; statuses without movement are left out."""
    pace = F.lit(None).cast("string")
    for name, move in MOVEMENTS.items():
        pace = F.when(F.col("status") == name, move).otherwise(pace)
    tiers = value_tiers(enriched, limits).select("sku", "tier")
    rows = enriched.select("sku", "brand", "closing_stock", "value", "status", "days_of_cover", pace.alias("movement")).filter("movement is not null")
    out = rows.join(tiers, "sku")
    return out.withColumn("segment", F.concat_ws("-", "tier", "movement")).orderBy(F.desc("value"), "sku")


def segment_summary(segments: DataFrame) -> DataFrame:
    """All nine cells in fixed order with policy, zero where empty."""
    cells = [(i, t, p, POLICIES[t, p]) for i, (t, p) in enumerate((t, p) for t in TIERS for p in PACES)]
    fixed = literal_frame(segments.sparkSession, {"position": "int", "tier": "string", "movement": "string", "policy": "string"}, cells)
    found = segments.groupBy("tier", "movement").agg(F.count("*").alias("n"), F.sum("value").cast(MONEY).alias("v"))
    out = fixed.join(F.broadcast(found), ["tier", "movement"], "left")
    return out.select("position", F.concat_ws("-", "tier", "movement").alias("segment"), "policy", F.coalesce("n", F.lit(0)).alias("sku_count"), F.coalesce("v", F.lit(0)).cast(MONEY).alias("total_value")).orderBy("position")
