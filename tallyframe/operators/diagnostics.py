"""Data quality, churn between reports, renames and catalog matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import balance_gap
from ..thresholds import BALANCE_TOLERANCE, VALUE_NOISE
from .reports import Scope


def quality_issues(history: DataFrame) -> DataFrame:
    """One row for each issue of each row, newest period first; the balance message has the signed gap."""
    gap = balance_gap()
    issue = lambda test, text: F.when(test, text)
    found = F.array(
        issue((F.col("closing_stock") > 0) & (F.col("value") < -VALUE_NOISE), F.lit("negative value with stock")),
        issue(F.col("closing_stock") < 0, F.lit("negative closing stock")),
        issue(F.col("opening_stock") < 0, F.lit("negative opening stock")),
        issue(F.col("sales") < 0, F.lit("negative sales")),
        issue(F.abs(gap) > BALANCE_TOLERANCE, F.concat(F.lit("stock does not balance by "), F.format_string("%+.1f", gap))),
    )
    rows = history.select("report_id", "period_end", "sku", "brand", F.filter(found, lambda x: x.isNotNull()).alias("issues"))
    return rows.filter(F.size("issues") > 0).select("report_id", "period_end", "sku", "brand", F.explode("issues").alias("issue"))


def first_issues(issues: DataFrame, n: int = 100) -> DataFrame:
    """The newest issues, for display."""
    return issues.orderBy(F.desc("period_end"), "sku", "issue").limit(n)


def quality_totals(issues: DataFrame) -> DataFrame:
    """How often each kind occurs; gaps of any size are one kind."""
    kind = F.when(F.col("issue").startswith("stock does not balance"), "stock does not balance").otherwise(F.col("issue"))
    return issues.groupBy(kind.alias("kind")).agg(F.count("*").alias("issues"))


def churn(history: DataFrame, scope: Scope, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, vanished) SKUs of the latest against the previous report, without those that ``pairs`` explains."""
    columns = ("sku", "brand", "closing_stock", "value")
    now = history.filter(F.col("report_id") == scope.latest_id).select(*columns)
    then = history.filter(F.col("report_id") == (-1 if scope.previous_id is None else scope.previous_id)).select(*columns)
    if scope.previous_id is None:
        return now.limit(0), now.limit(0)
    new, gone = now.join(then, "sku", "left_anti"), then.join(now, "sku", "left_anti")
    if pairs is not None:
        new = new.join(pairs.select(F.col("new_name").alias("sku")), "sku", "left_anti")
        gone = gone.join(pairs.select(F.col("old_name").alias("sku")), "sku", "left_anti")
    return new, gone


def listed(rows: DataFrame, n: int = 50) -> DataFrame:
    """The dearest rows with the true total."""
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy(F.desc("value"), "sku").limit(n)


def alias_map(renames: DataFrame) -> DataFrame:
    """The latest new name of every old name; chains are not followed."""
    return renames.groupBy("old_name").agg(F.max_by("new_name", "seq").alias("new_name"))


def rename_pairs(new: DataFrame, gone: DataFrame, aliases: DataFrame) -> DataFrame:
    """Vanished names whose alias is a new name; each new name goes to the smallest old name."""
    found = gone.select(F.col("sku").alias("old_name")).join(aliases, "old_name").join(new.select(F.col("sku").alias("new_name")), "new_name", "left_semi")
    first = Window.partitionBy("new_name").orderBy("old_name")
    return found.withColumn("n", F.row_number().over(first)).filter("n = 1").select("old_name", "new_name")


def catalog_names(catalog: DataFrame) -> DataFrame:
    """Distinct non-empty product and long names."""
    both = catalog.select(F.trim("product_name").alias("name")).union(catalog.select(F.trim("long_name").alias("name")))
    return both.filter("name is not null and name <> ''").distinct()


def unmatched(snapshot: DataFrame, names: DataFrame) -> DataFrame:
    """Current SKUs that the catalog doesn't name; nothing if the catalog is empty."""
    out = snapshot.withColumn("name", F.trim("sku")).join(names, "name", "left_anti").drop("name")
    known = names.agg((F.count("*") > 0).alias("known"))
    return out.crossJoin(F.broadcast(known)).filter("known").drop("known")
