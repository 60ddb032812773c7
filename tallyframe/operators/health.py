"""What an import screen shows at once: gaps, problem files, the catalog, unmatched and changed SKUs, quality findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diagnostics, reports, store
from .enriched import current_snapshot


def import_health(history: DataFrame, live: DataFrame, ledger: DataFrame, catalog: DataFrame, renames: DataFrame, target: int) -> dict[str, DataFrame]:
    """The parts by name. Lists are capped for display as elsewhere and come with the true total; ``history`` without reports gives empty lists."""
    scope = reports.scope(history, target)
    out = {
        "last_refresh": store.last_refresh(ledger),
        "missing_months": reports.missing_months(live),
        "coverage_gaps": reports.coverage_gaps(live),
        "problem_files": store.problem_files(ledger),
        "item_catalog": store.catalog_meta(catalog),
    }
    issues = diagnostics.quality_issues(history)
    if scope is None:
        return out | {"quality_issues": diagnostics.first_issues(issues), "quality_totals": diagnostics.quality_totals(issues)}
    new, gone = diagnostics.churn(history, scope)
    pairs = diagnostics.rename_pairs(new, gone, diagnostics.alias_map(renames))
    new, gone = diagnostics.churn(history, scope, pairs)
    missing = diagnostics.unmatched(current_snapshot(history, scope), diagnostics.catalog_names(catalog))
    return out | {
        "unmatched_skus": diagnostics.listed(missing, 100),
        "new_skus": diagnostics.listed(new),
        "vanished_skus": diagnostics.listed(gone),
        "likely_renames": pairs,
        "quality_issues": diagnostics.first_issues(issues),
        "quality_totals": diagnostics.quality_totals(issues),
    }


def overview(parts: dict[str, DataFrame]) -> DataFrame:
    """``(section, rows)``: how many rows each part has."""
    counts = [part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows") for name, part in parts.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


#: What names a row of each part, and its number.
_SAID = {
    "last_refresh": (("last_refresh",), None),
    "missing_months": (("month", "label"), None),
    "coverage_gaps": (("gap_start", "gap_end"), "days"),
    "problem_files": (("filename", "status", "checked_at"), None),
    "item_catalog": (("imported_at",), "item_count"),
    "unmatched_skus": (("brand", "sku", "value"), "total"),
    "new_skus": (("brand", "sku", "value"), "total"),
    "vanished_skus": (("brand", "sku", "value"), "total"),
    "likely_renames": (("old_name", "new_name"), None),
    "quality_issues": (("report_id", "period_end", "sku", "issue"), None),
    "quality_totals": (("kind",), "issues"),
}


def contents(parts: dict[str, DataFrame]) -> DataFrame:
    """``(section, item, number)``: every row of every part, as text joined by bars, and its count or days where it has one."""
    out = None
    for name, part in parts.items():
        columns, number = _SAID[name]
        item = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        rows = part.select(F.lit(name).alias("section"), item.alias("item"), (F.lit(None) if number is None else F.col(number)).cast("long").alias("number"))
        out = rows if out is None else out.unionByName(rows)
    return out
