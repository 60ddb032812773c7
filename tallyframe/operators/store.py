"""Which reports are live: an append-only import log, a file ledger, catalog snapshots and renames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import literal_frame
from ..sources.scratch import scratch_folder
from .reports import dimension


def live_reports(log: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Imports that no later import overlaps and no later removal names; the newest wins, within each store if there are ``keys``.

    Periods overlap exactly where they share a day, so each day keeps the newest import that covers it, and an import that isn't the newest on
    all of its days is superseded. That grows with the days covered, not with pairs of imports.
    """
    imports = log.filter("event = 'import'").drop("event")
    store = F.struct(*[F.col(k) for k in keys], F.lit(0)).alias("_store")  # null keys are a store too
    days = imports.filter("period_start <= period_end").select(store, "seq", F.explode(F.sequence("period_start", "period_end")).alias("_day"))
    newest = days.groupBy("_store", "_day").agg(F.max("seq").alias("_newest"))
    old = days.join(newest, ["_store", "_day"]).filter(F.col("_newest") > F.col("seq"))
    removed = log.filter("event = 'remove'").groupBy(store, "period_start", "period_end").agg(F.max("seq").alias("_removed"))
    gone = imports.select(store, "seq", "period_start", "period_end").join(removed, ["_store", "period_start", "period_end"]).filter(F.col("_removed") > F.col("seq"))
    over = old.select("_store", "seq").unionByName(gone.select("_store", "seq"))
    return imports.withColumn("_store", store).join(over, ["_store", "seq"], "left_anti").select(*imports.columns)


def overlaps(live: DataFrame, period_start: str, period_end: str) -> DataFrame:
    """Live reports that overlap a period but are not exactly it."""
    a, b = F.lit(period_start).cast("date"), F.lit(period_end).cast("date")
    same = (F.col("period_start") == a) & (F.col("period_end") == b)
    return live.filter((F.col("period_start") <= b) & (F.col("period_end") >= a) & ~same)


def exact_period(live: DataFrame, period_start: str, period_end: str) -> DataFrame:
    return live.filter((F.col("period_start") == F.lit(period_start).cast("date")) & (F.col("period_end") == F.lit(period_end).cast("date")))


def filename_conflicts(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming files whose name belongs to a live report of a period that differs and does not overlap."""
    new = incoming.select("filename", F.col("period_start").alias("new_start"), F.col("period_end").alias("new_end"))
    apart = (F.col("period_start") > F.col("new_end")) | (F.col("period_end") < F.col("new_start"))
    return live.join(new, "filename").filter(apart).select("filename", "period_start", "period_end", "new_start", "new_end")


def latest_ledger(ledger: DataFrame) -> DataFrame:
    """The last entry of every file of an append-only ledger."""
    last = Window.partitionBy("filename").orderBy(F.desc("checked_at"), F.desc("seq"))
    return ledger.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n")


def problem_files(ledger: DataFrame, n: int = 20) -> DataFrame:
    return latest_ledger(ledger).filter("status <> 'imported'").orderBy(F.desc("checked_at"), "filename").limit(n)


def last_refresh(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.max("checked_at").alias("last_refresh"))


def report_listing(reports: DataFrame, entries: DataFrame) -> DataFrame:
    """Reports by end with their SKU count, zero where they have no rows."""
    counts = entries.groupBy("report_id").agg(F.count("*").alias("n"))
    out = reports.join(counts, "report_id", "left").withColumn("sku_count", F.coalesce("n", F.lit(0)))
    return out.select("report_id", "period_start", "period_end", "period_days", "sku_count").orderBy("period_end", "period_start")


def catalog_renames(old: DataFrame, new: DataFrame, after: int = 0) -> DataFrame:
    """Name changes of codes that both catalogs have: ``seq, code, old_name, new_name``.

    A changed product name is logged if both are non-empty; a changed long name likewise, unless the old one equals the
    old product name. Numbers follow code and kind, from ``after`` + 1.
    """
    both = old.select("code", F.col("product_name").alias("p0"), F.col("long_name").alias("l0")).join(new.select("code", F.col("product_name").alias("p1"), F.col("long_name").alias("l1")), "code")
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    product = F.when(said("p0") & said("p1") & (F.col("p0") != F.col("p1")), F.struct(F.lit(0).alias("kind"), F.col("p0").alias("old_name"), F.col("p1").alias("new_name")))
    long = F.when(said("l0") & said("l1") & (F.col("l0") != F.col("l1")) & ~F.col("l0").eqNullSafe(F.col("p0")), F.struct(F.lit(1).alias("kind"), F.col("l0").alias("old_name"), F.col("l1").alias("new_name")))
    found = both.select("code", F.explode(F.filter(F.array(product, long), lambda x: x.isNotNull())).alias("r")).select("code", "r.*")
    return numbered(found, ["code", "kind"], after).select("seq", "code", "old_name", "new_name")


def numbered(rows: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """``rows`` with ``seq`` from ``after`` + 1 in the given order, without bringing all of them into one task.

    Rows are cut into ranges and written once, so that the ranges stay what they are; the sizes of the ranges before a row's (a
    number for each range) are added to its place in its own.
    """
    path = scratch_folder(rows.sparkSession)
    rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()).write.parquet(path)
    cut = rows.sparkSession.read.parquet(path)
    before, total = [], after
    for r in cut.groupBy("range_no").agg(F.count("*").alias("n")).orderBy("range_no").collect():
        before.append((r["range_no"], total))
        total += r["n"]
    offsets = literal_frame(rows.sparkSession, {"range_no": "int", "before": "long"}, before or [(0, after)])
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return cut.withColumn("place", place).join(offsets, "range_no").withColumn("seq", F.col("place") + F.col("before")).drop("range_no", "place", "before")


def duplicate_codes(catalog: DataFrame) -> DataFrame:
    """Codes that would reject an upload."""
    return catalog.groupBy("code").agg(F.count("*").alias("times")).filter("times > 1")


def uploaded(current: DataFrame, upload: DataFrame) -> DataFrame:
    """The catalog after an upload: the upload as a whole or, if any code occurs in it twice, what was there before."""
    bad = duplicate_codes(upload).agg((F.count("*") > 0).alias("bad"))  # one row
    names = current.columns
    taken = upload.select(*names, F.lit(False).alias("keeps")).unionByName(current.select(*names, F.lit(True).alias("keeps")))
    return taken.join(bad, F.col("keeps") == F.col("bad")).select(*names)


def rollback(renames: DataFrame, watermark: int) -> DataFrame:
    """Renames up to a watermark; the catalog itself comes from ``snapshot``."""
    return renames.filter(F.col("seq") <= watermark)


def snapshot(versions: DataFrame, version: int) -> DataFrame:
    """The catalog as of a version: ``versions`` keeps every import as rows of its own number."""
    last = versions.filter(F.col("version") <= version).agg(F.max("version").alias("version"))  # one row
    return versions.join(last, "version").drop("version")


def catalog_meta(catalog: DataFrame) -> DataFrame:
    """When the catalog came in and how many items it has; no row if it is empty."""
    return catalog.agg(F.max("imported_at").alias("imported_at"), F.count("*").alias("item_count")).filter("item_count > 0")


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Imports of one store in order."""
    pdf = pdf.sort_values("seq", kind="stable")
    live, out = set(), []
    for f in pdf.itertuples():
        if pd.isna(f.period_start) or pd.isna(f.period_end):
            out.append("no_period")
        elif not f.n_rows:
            out.append("no_rows")
        elif (f.period_start, f.period_end) in live and not f.replace:
            out.append("period_exists")
        else:
            out.append("accepted")
            live = {p for p in live if p[0] > f.period_end or p[1] < f.period_start} | {(f.period_start, f.period_end)}
    return pd.DataFrame({"store": pdf["store"], "seq": pdf["seq"], "outcome": out})


def judge_imports(imports: DataFrame) -> DataFrame:
    """``(store, seq, outcome)``: whether each import is accepted, or has no period, no rows, or a period that is live already and isn't to be replaced.

    ``imports`` has ``store, seq, period_start, period_end, n_rows, replace``, one row for each file. What is live depends on
    the imports before, so each store's rows (metadata only) are folded in order by one task.
    """
    return imports.groupBy("store").applyInPandas(_judge, "store string, seq long, outcome string")


def incremental(known: DataFrame, history: DataFrame) -> DataFrame:
    """Known rows and those of the reports that are not known yet."""
    fresh = history.join(dimension(known).select("report_id"), "report_id", "left_anti")
    return known.unionByName(fresh)


def candidate_files(files: DataFrame) -> DataFrame:
    """Spreadsheets by relative path, without temporary and hidden ones."""
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.startswith("~$"))
    return files.filter(F.lower("path").rlike(r"\.xlsx?$") & ~hidden).orderBy("path")


@dataclass
class Ledger:
    """What one store knows of its files and reports: each file's size, time and report, and each live report's period.

    Reports are known by number, as one of the same period may be another one.
    """

    files: dict[str, tuple[int, int, int | None]] = field(default_factory=dict)
    live: dict[int, tuple[date, date]] = field(default_factory=dict)
    number: int = 0

    def take(self, path: str, size: int, mtime: int, failed: bool, n_rows: int, start: date | None, end: date | None) -> tuple[str, int | None, list[int], list[str]]:
        """A file's status, its report's number, reports that it replaces, and files that are forgotten with them."""
        seen = self.files.get(path)
        if seen and seen[:2] == (size, mtime):
            return "unchanged", None, [], []
        held = seen[2] if seen else None
        if failed or start is None or end is None or not n_rows:
            self.files[path] = (size, mtime, None)
            return "error", None, [], []
        meets = [n for n, p in self.live.items() if p[0] <= end and p[1] >= start]
        same = next((n for n in meets if self.live[n] == (start, end)), None)
        if held in self.live and held not in meets:
            self.files[path] = (size, mtime, held)
            return "filename_reused", None, [], []
        if same is not None and same != held:
            self.files[path] = (size, mtime, same)
            return "duplicate_period", None, [], []
        forgot = self._drop([n for n in meets if n != same])
        if same is not None:
            del self.live[same]
            self.files |= {p: (*f[:2], None) for p, f in self.files.items() if f[2] == same}
        self.number += 1
        self.live[self.number] = (start, end)
        self.files[path] = (size, mtime, self.number)
        return "imported", self.number, meets, [p for p in forgot if p != path]

    def remove(self, start: date | None, end: date | None) -> tuple[str, int | None, list[int], list[str]]:
        """Removes the live report of exactly this period, if there is one, and forgets its files, so that they come again."""
        gone = [n for n, p in self.live.items() if p == (start, end)]
        return ("removed" if gone else "not_found"), None, gone, self._drop(gone)

    def _drop(self, gone: list[int]) -> list[str]:
        forgot = [p for p, f in self.files.items() if f[2] in gone]
        for p in forgot:
            del self.files[p]
        for n in gone:
            del self.live[n]
        return forgot


def day(x) -> date | None:
    """A date of a pandas frame."""
    return None if pd.isna(x) else x


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Files of one store in path order, each seeing what the ones before it did."""
    pdf, ledger = pdf.sort_values(["batch", "path"], kind="stable"), Ledger()
    status = [ledger.take(f.path, f.size, f.mtime, f.failed, f.n_rows, day(f.period_start), day(f.period_end))[0] for f in pdf.itertuples()]
    return pd.DataFrame({"store": pdf["store"], "batch": pdf["batch"], "path": pdf["path"], "status": status})


def classify_files(files: DataFrame) -> DataFrame:
    """Status of every incoming file: unchanged, error, filename_reused, duplicate_period or imported, first match wins.

    ``files`` has ``store, batch, path, size, mtime, failed, n_rows, period_start, period_end``. What a file means depends on the
    ones before it, so each store's files (metadata only, a row for each file) are folded in order by one task.
    """
    return files.groupBy("store").applyInPandas(_fold, "store string, batch long, path string, status string")
