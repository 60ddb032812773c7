"""The analytics for many stores in one plan: what the single-store operators say of each store alone.

``keys`` name a store; null is a value like any other. The report dimension of all stores, small as it is, stays a table: it is joined with
the rows, which prunes periods that no store needs, and one aggregation by store and SKU yields current stock, pace and activity
together. Fixed categories are completed within the aggregation by store, so no store is collected and none has a plan of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import AGES, MOVEMENTS, PACES, STATUSES, TIERS, period_label, status
from ..thresholds import LOOKBACK_FLOOR, Thresholds
from .enriched import pace
from .reports import LATEST, trailing_window
from .rollups import LIST, MONEY
from .segments import POLICIES, bucket

KEYS = ("company", "location")
_REPORT = ("report_id", "period_start", "period_end", "period_days")


def _store(keys: tuple[str, ...]) -> Column:
    """A store as one value, so that null keys meet in joins."""
    return F.struct(*keys).alias("_store")


def dimension(history: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The reports of every store."""
    return history.select(*keys, *_REPORT).dropDuplicates([*keys, "report_id"])


def scoped(reports: DataFrame, limits: Thresholds, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``reports`` with what their store's dimension says: latest and first report, lookback, trailing window and its days."""
    own = Window.partitionBy(*keys)
    order = F.struct(*LATEST)
    out = trailing_window(reports, limits.trailing_days, keys).drop("days_before").withColumnRenamed("taken", "trailing")
    out = out.withColumns({
        "latest_end": F.max("period_end").over(own),
        "latest": F.max(order).over(own) == order,
        "first_start": F.min(order).over(own)["period_start"],
        "trailing_days": F.sum(F.when(F.col("trailing"), F.col("period_days"))).over(own),
    })
    since = F.date_sub("latest_end", max(limits.dead_stock_days, LOOKBACK_FLOOR))
    return out.withColumn("since", since).withColumn("recent", F.col("period_end") >= since)


def history_meta(reports: DataFrame, limits: Thresholds, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of each store: the first report's start, the latest end, count and trailing days."""
    found = scoped(reports, limits, keys).groupBy(*keys)
    return found.agg(F.max("first_start").alias("earliest_period_start"), F.max("latest_end").alias("latest_period_end"), F.count("*").alias("report_count"), F.max("trailing_days").alias("trailing_days"))


def enriched(history: DataFrame, limits: Thresholds, keys: tuple[str, ...] = KEYS, reports: DataFrame | None = None) -> DataFrame:
    """One row for each SKU of each store's latest report, as ``enriched.enriched`` has it for one store.

    ``reports`` is the dimension if there is a table of it; else it is taken from the history's own columns.
    """
    said = scoped(dimension(history, keys) if reports is None else reports, limits, keys).filter("trailing or recent or latest")
    said = said.select(_store(keys), "report_id", "period_end", "trailing", "recent", "latest", "latest_end", "first_start", "trailing_days", "since")
    rows = history.withColumn("_store", _store(keys)).join(F.broadcast(said), ["_store", "report_id", "period_end"])  # a row for each report of a store
    recent, sold = F.col("recent"), (F.col("sales") > 0) | (F.col("sales_free") > 0)
    facts = rows.groupBy(*keys, "sku").agg(
        F.max(F.when(F.col("latest"), F.struct("closing_stock", "value", "brand"))).alias("now"),
        *pace(),
        F.max(F.when(recent & (F.col("purchase") > 0), F.col("period_end"))).alias("last_purchase"),
        F.max(F.when(recent & sold, F.col("period_end"))).alias("last_sale"),
        *[F.max(c).alias(c) for c in ("latest_end", "first_start", "trailing_days", "since")],
    )
    out = facts.filter("now is not null").select("*", "now.brand", "now.closing_stock", "now.value")
    out = out.fillna(0.0, ["trailing_opening", "trailing_purchase", "trailing_sales", "trailing_sales_free", "trailing_other_issue"])
    last = F.coalesce(F.greatest("last_purchase", "last_sale"), F.greatest("since", "first_start"))
    demand = F.col("trailing_sales") + F.col("trailing_sales_free")
    out = out.withColumn("last_activity", last).withColumn("days_since_activity", F.datediff("latest_end", "last_activity"))
    out = out.withColumns({"is_dead": F.col("days_since_activity") >= limits.dead_stock_days, "daily_demand": demand / F.col("trailing_days").cast("double"), "is_returned": (demand == 0) & (F.col("trailing_other_issue") > 0)})
    out = out.withColumn("days_of_cover", F.when(F.col("daily_demand") > 0, F.col("closing_stock") / F.col("daily_demand")).otherwise(F.lit(float("inf"))))
    return out.withColumn("status", status(limits.low_stock_days, limits.overstock_days)).select(
        *keys, "sku", "brand", "closing_stock", "value", "trailing_opening", "trailing_purchase", "trailing_sales", "trailing_sales_free", "trailing_other_issue",
        "daily_demand", "days_of_cover", "last_activity", "days_since_activity", "is_dead", "is_returned", "status",
    )


def _cells(rows: DataFrame, keys: tuple[str, ...], cells: list[tuple[dict[str, Column], Column]]) -> DataFrame:
    """For each store and fixed cell ``(its columns, test)`` the count and value of the rows that pass; zero where there are none."""
    sums = []
    for i, (_, test) in enumerate(cells):
        sums += [F.count(F.when(test, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0)).cast(MONEY).alias(f"v{i}")]
    told = [F.struct(F.lit(i).alias("position"), *[c.alias(n) for n, c in names.items()], F.col(f"n{i}").alias("sku_count"), F.col(f"v{i}").alias("total_value")) for i, (names, _) in enumerate(cells)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*told)).alias("cell")).select(*keys, "cell.*")


def status_rollup(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Count and value of every status of every store, in fixed order, zero where there is none."""
    return _cells(rows, keys, [({"status": F.lit(s)}, F.col("status") == s) for s in STATUSES])


def dead_aging(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Dead stock of every store by age, all ages present."""
    days, dead = F.col("days_since_activity"), F.col("status") == "dead_stock"
    return _cells(rows, keys, [({"bucket": F.lit(label)}, dead & (days >= low) & (F.lit(True) if high is None else days < high)) for label, low, high in AGES])


def kpis(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("sku_count"), F.countDistinct("brand").alias("brand_count"), F.sum("value").cast(MONEY).alias("total_value"), F.sum("closing_stock").alias("total_closing"))


def _first(rows: DataFrame, keys: tuple[str, ...], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each store; Spark keeps no more than that of a store before it shuffles."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def top_brands(rows: DataFrame, n: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    sums = rows.filter("brand is not null").groupBy(*keys, "brand").agg(F.sum("value").cast(MONEY).alias("total_value"))
    return _first(sums, keys, n, F.desc("total_value"), "brand")


def top_skus(rows: DataFrame, by: str, n: int = 15, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each store's leaders by ``value`` or by paid ``trailing_sales``."""
    return _first(rows.select(*keys, "sku", "brand", "closing_stock", "value", "trailing_sales"), keys, n, F.desc(by), "sku")


def action_list(rows: DataFrame, wanted: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The SKUs of one status in every store."""
    return rows.filter(F.col("status") == wanted).select(*keys, *LIST, *(("days_since_activity",) if wanted == "dead_stock" else ()))


def value_tiers(rows: DataFrame, limits: Thresholds, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``sku, value, tier`` of every store's stocked SKUs, with a running sum in two levels: over a store's value buckets, then within each."""
    stocked = rows.filter("closing_stock > 0").select(*keys, "sku", "value").withColumn("bucket", bucket())
    sums = stocked.groupBy(*keys, "bucket").agg(F.sum("value").cast(MONEY).alias("s"))
    own = Window.partitionBy(*keys)
    higher = own.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select(_store(keys), "bucket", F.coalesce(F.sum("s").over(higher), F.lit(0)).cast(MONEY).alias("above"), F.sum("s").over(own).cast(MONEY).alias("total"))
    inside = Window.partitionBy("_store", "bucket").orderBy(F.desc("value"), "sku").rowsBetween(Window.unboundedPreceding, -1)
    out = stocked.withColumn("_store", _store(keys)).join(above, ["_store", "bucket"])
    out = out.withColumn("before", F.col("above") + F.coalesce(F.sum("value").over(inside), F.lit(0)))
    below = lambda pct: F.col("before") * 100 < F.col("total") * pct
    tier = F.when(F.col("total") <= 0, "C").when(below(limits.tier_a_pct), "A").when(below(limits.tier_b_pct), "B").otherwise("C")
    return out.select(*keys, "sku", "value", tier.alias("tier"))


def value_segments(rows: DataFrame, limits: Thresholds, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every store's stocked SKUs with tier, movement and segment."""
    moves = F.create_map(*[F.lit(x) for pair in MOVEMENTS.items() for x in pair])
    tiers = value_tiers(rows, limits, keys).select(_store(keys), "sku", "tier")
    found = rows.select(*keys, _store(keys), "sku", "brand", "closing_stock", "value", "status", "days_of_cover", F.try_element_at(moves, "status").alias("movement")).filter("movement is not null")
    return found.join(tiers, ["_store", "sku"]).drop("_store").withColumn("segment", F.concat_ws("-", "tier", "movement"))


def segment_summary(segments: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All nine cells of every store that has a segment, in fixed order with policy."""
    cells = [({"segment": F.lit(f"{t}-{p}"), "policy": F.lit(POLICIES[t, p])}, F.col("segment") == f"{t}-{p}") for t in TIERS for p in PACES]
    return _cells(segments, keys, cells)


def trend(history: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Value and paid sales of every store's reports."""
    sums = history.groupBy(*keys, "report_id", "period_start", "period_end").agg(F.coalesce(F.sum("value"), F.lit(0)).cast(MONEY).alias("total_value"), F.sum("sales").alias("total_sales"))
    return sums.withColumn("label", period_label(F.col("period_start"), F.col("period_end")))


def trend_top_brands(history: DataFrame, rows: DataFrame, n: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Paid sales of every store's leading brands in each of its reports, zero where a brand has none."""
    leaders = top_brands(rows, n, keys).select(_store(keys), "brand")
    every = dimension(history, keys).select(*keys, _store(keys), "report_id").join(leaders, "_store")
    sums = history.select(_store(keys), "brand", "report_id", "sales").join(leaders, ["_store", "brand"], "left_semi").groupBy("_store", "brand", "report_id").agg(F.sum("sales").alias("s"))
    return every.join(sums, ["_store", "brand", "report_id"], "left").select(*keys, "brand", "report_id", F.coalesce("s", F.lit(0.0)).alias("total_sales"))
