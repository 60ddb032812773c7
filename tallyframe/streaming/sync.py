"""Folders of statements kept in sync with a history, scan by scan.

A scan lists a folder, leaves out files that the ledger knows as they are, reads the others and writes their rows and, for each, one
event. A stream takes the events, by store, through the import rules: the ledger and the live periods of a store live in the state store and pass
from one micro-batch to the next. Each batch writes what was decided and appends the rows of imported reports to the
history. Replaced and removed reports leave the history's live view at once, as that is a join with the live reports, and leave its files
when the touched periods are compacted.

Every batch writes folders of its own number and replaces them, so a batch that is run again leaves no copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.expressions import NUMERICS
from ..operators.ingest import dedupe_entries, statement_rows
from ..operators.store import Ledger, day
from ..sources import folders
from ..sources.files import numbered_rows

#: An event is a file as a scan found it (``file``) or the removal of the report of a period (``remove``).
EVENT = (
    "store string, scan long, event string, path string, size long, mtime long, failed boolean, n_rows long, company string, location string, "
    "period_start date, period_end date"
)
DECISION = (
    "store string, scan long, step long, event string, path string, size long, mtime long, status string, number long, company string, location string, "
    "period_start date, period_end date, gone array<long>, forgot array<string>"
)
_ROW = "file string, sku string, brand string, " + ", ".join(f"{n} double" for n in NUMERICS)
_ENTRY = f"store string, number long, {_ROW}, period_end date, batch long"
#: Settings that the stream's session takes over from the caller's.
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")


@dataclass(frozen=True)
class Home:
    """The folders of a synced history below one path."""

    path: str

    def __getattr__(self, name: str) -> str:
        if name in ("sheets", "rows", "events", "decisions", "entries", "changes", "activity", "compacted", "checkpoint"):
            return f"{self.path}/{name}"
        raise AttributeError(name)


class Sync(StatefulProcessor):
    """One store's events in order: scan by scan, removals before files, files by path."""

    def init(self, handle) -> None:
        self.files = handle.getMapState("files", "path string", "size long, mtime long, report long")
        self.live = handle.getMapState("live", "report long", "period_start date, period_end date")
        self.last = handle.getValueState("last", "number long, step long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        number, step = self.last.get() if self.last.exists() else (0, 0)
        none = lambda x: None if x is None or x < 0 else x
        ledger = Ledger({k[0]: (v[0], v[1], none(v[2])) for k, v in self.files.iterator()}, {k[0]: (v[0], v[1]) for k, v in self.live.iterator()}, number)
        files, live = dict(ledger.files), dict(ledger.live)
        events = pd.concat(list(rows)).sort_values(["scan", "event", "path"], ascending=[True, False, True], kind="stable")
        out = []
        for e in events.itertuples():
            step += 1
            start, end = day(e.period_start), day(e.period_end)
            what = ledger.remove(start, end) if e.event == "remove" else ledger.take(e.path, int(e.size), int(e.mtime), bool(e.failed), int(e.n_rows), start, end)
            out.append((key[0], e.scan, step, e.event, e.path, e.size, e.mtime, what[0], what[1], e.company, e.location, start, end, what[2], what[3]))
        self._write(self.files, files, {p: (f[0], f[1], -1 if f[2] is None else f[2]) for p, f in ledger.files.items()}, ledger.files)
        self._write(self.live, live, ledger.live, ledger.live)
        self.last.update((ledger.number, step))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])
        yield made.astype({c: "Int64" for c in ("scan", "step", "size", "mtime", "number")})

    @staticmethod
    def _write(state, before: dict, after: dict, plain: dict) -> None:
        """Puts into the state what has changed."""
        for k in before.keys() - after.keys():
            state.removeKey((k,))
        for k, v in after.items():
            if before.get(k) != plain[k]:
                state.updateValue((k,), v)

    def close(self) -> None:
        pass


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table; none before the first."""
    return spark.read.schema(schema).parquet(path) if folders.exists(spark, path) else spark.createDataFrame([], schema)


def decisions(spark: SparkSession, home: Home) -> DataFrame:
    """What was decided about every event so far; ``step`` counts a store's events."""
    return _written(spark, home.decisions, DECISION)


def ledger(spark: SparkSession, home: Home) -> DataFrame:
    """``(store, path, size, mtime)``: files as they were last seen, without those whose report was dropped."""
    made = decisions(spark, home)
    seen = made.filter("event = 'file'").select("store", "path", "step", F.struct("size", "mtime").alias("last"))
    lost = made.select("store", F.explode("forgot").alias("path"), "step", F.lit(None).cast("struct<size:long,mtime:long>").alias("last"))
    last = seen.unionByName(lost).groupBy("store", "path").agg(F.max_by(F.struct("last"), "step").alias("at"))
    return last.filter("at.last is not null").select("store", "path", "at.last.size", "at.last.mtime")


def live(spark: SparkSession, home: Home) -> DataFrame:
    """``(store, number, path, company, location, period_start, period_end)`` of the reports that nothing has replaced or removed."""
    made = decisions(spark, home)
    gone = made.select("store", F.explode("gone").alias("number"))
    found = made.filter("status = 'imported'").join(gone, ["store", "number"], "left_anti")
    return found.select("store", "number", "path", "company", "location", "period_start", "period_end")


def live_history(spark: SparkSession, home: Home) -> DataFrame:
    """The joined history of all live reports, as the analytics take it, with ``store``; ``report_id`` counts within a store.

    Periods without a live report are pruned when the join runs.
    """
    reports = live(spark, home).withColumn("period_days", F.datediff("period_end", "period_start") + 1).drop("path")
    rows = _written(spark, home.entries, _ENTRY).drop("file", "batch").join(F.broadcast(reports), ["store", "number", "period_end"])
    numbers = [F.col(n).cast("decimal(18,2)") if n == "value" else n for n in NUMERICS]
    return rows.select("store", F.col("number").alias("report_id"), "period_start", "period_end", "period_days", "company", "location", "brand", "sku", *numbers)


def _next_scan(spark: SparkSession, home: Home) -> int:
    path, fs = folders.hadoop_path(spark, home.events)
    return 1 + max([int(f.getPath().getName()) for f in fs.listStatus(path)], default=0) if fs.exists(path) else 1


def _write_rows(found: DataFrame, path: str, spare: str) -> None:
    """Writes a scan's items, one row for each file and SKU.

    Items as they are read lie together by sheet, and hardly any is there twice. So they are written without a shuffle, and of them all only hashes
    are; if some are repeated, those alone are brought together and added up, and the whole takes the place of what was written.
    """
    spark, names = found.sparkSession, [c.split()[0] for c in _ROW.split(", ")]
    found.select(*names, "row_no").write.mode("overwrite").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(f"{_ROW}, row_no int").parquet(path).withColumn("_item", F.xxhash64("file", "sku"))
    twice = rows.groupBy("_item").agg(F.count("*").alias("n")).filter("n > 1").select("_item")
    if twice.isEmpty():
        return
    once = rows.join(twice, "_item", "left_anti").select(names)
    once.unionByName(dedupe_entries(rows.join(twice, "_item", "left_semi")).select(names)).write.mode("overwrite").option("compression", "zstd").parquet(spare)
    _, fs = folders.hadoop_path(spark, path)
    folders.delete(spark, path)
    fs.rename(folders.hadoop_path(spark, spare)[0], folders.hadoop_path(spark, path)[0])


def scan(spark: SparkSession, home: Home, folder: str, store: Column | None = None, removals: DataFrame | None = None) -> int:
    """Writes the events of a folder's new and changed files and of ``removals (store, period_start, period_end)``; how many files they are.

    ``store`` is a column over a file's relative ``path``; without it all files are of one store. The paths of files to read are collected, as the
    driver has listed the folder anyway.
    """
    number = _next_scan(spark, home)
    store = F.lit("main") if store is None else store
    known = ledger(spark, home).drop("store")
    files = folders.changed(folders.listing(spark, folder), known)
    files = spark.createDataFrame(files.collect(), folders.FILES)
    paths = [r["path"] for r in files.collect()]
    common = [F.lit(number).cast("long").alias("scan")]
    events = None
    if paths:
        sheets, path = f"{home.sheets}/{number}", f"{home.rows}/{number}"  # each file is opened once
        folders.read_sheets(spark, folder, paths).write.mode("overwrite").option("compression", "zstd").parquet(sheets)
        grid = numbered_rows(spark.read.parquet(sheets))
        _write_rows(statement_rows(grid), path, f"{home.path}/repeated")
        facts = folders.described(files, grid, spark.read.schema(_ROW).parquet(path))
        events = facts.select(store.alias("store"), *common, F.lit("file").alias("event"), "path", "size", "mtime", "failed", "n_rows", "company", "location", "period_start", "period_end")
    if removals is not None:
        none = {c: F.lit(None) for c in ("size", "mtime", "failed", "n_rows", "company", "location")}
        drops = removals.select("store", *common, F.lit("remove").alias("event"), F.lit("").alias("path"), *[c.alias(n) for n, c in none.items()], "period_start", "period_end")
        events = drops if events is None else events.unionByName(drops)
    if events is not None:
        typed = events.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in EVENT.split(", ")])
        # a store's events of one scan lie in one file, so no micro-batch splits them
        typed.repartition("store").write.mode("overwrite").parquet(f"{home.events}/{number}")
        folders.delete(spark, f"{home.sheets}/{number}")
    return len(paths)


def stateful(spark: SparkSession) -> SparkSession:
    """A session for streams with map states, so that the caller's settings stay as they are."""
    quiet = spark.newSession()
    for name in _KEPT:
        quiet.conf.set(name, spark.conf.get(name))
    quiet.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return quiet


def _movements(spark: SparkSession, home: Home, reports: DataFrame) -> DataFrame:
    """Where SKUs moved in some reports ``(store, number, period_end)``: paid purchases and any sales."""
    rows = _written(spark, home.entries, _ENTRY).join(F.broadcast(reports), ["store", "number", "period_end"])
    dated = lambda test: F.when(test, F.col("period_end"))
    moved = rows.select("store", "sku", "number", dated(F.col("purchase") > 0).alias("bought"), dated((F.col("sales") > 0) | (F.col("sales_free") > 0)).alias("sold"))
    return moved.filter("bought is not null or sold is not null")


def decide(spark: SparkSession, home: Home):
    """Takes all waiting events through the rules; the stream ends when there are none left."""
    quiet = stateful(spark)

    def save(batch: DataFrame, number: int) -> None:
        path = f"{home.decisions}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        batch = quiet.read.schema(DECISION).parquet(path)
        made = batch.filter("status = 'imported'")
        scans = [r["scan"] for r in made.select("scan").distinct().collect()]
        for n in scans:
            reports = made.filter(F.col("scan") == n).select("store", "number", F.col("path").alias("file"), "period_end")
            rows = quiet.read.schema(_ROW).parquet(f"{home.rows}/{n}").join(F.broadcast(reports), "file").withColumn("batch", F.lit(number).cast("long")).withColumn("scan", F.lit(n))
            names = [c.split()[0] for c in _ENTRY.split(", ")]
            # a scan's rows lie together by sheet, so a task has few periods
            rows.select(*names, "scan").write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("period_end", "batch", "scan").parquet(home.entries)
        # what a batch changes: movements of reports that have come and of those that have gone
        every = decisions(quiet, home).filter("status = 'imported'").select("store", "number", "period_end")
        gone = every.join(batch.select("store", F.explode("gone").alias("number")), ["store", "number"], "left_semi")
        came = _movements(quiet, home, made.select("store", "number", "period_end")).withColumn("gone", F.lit(False))
        came.unionByName(_movements(quiet, home, gone).withColumn("gone", F.lit(True))).write.mode("overwrite").parquet(f"{home.changes}/{number}")

    stream = quiet.readStream.schema(EVENT).parquet(f"{home.events}/*")
    decided = stream.groupBy("store").transformWithStateInPandas(Sync(), DECISION, "Update", "none")
    return decided.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", home.checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, home: Home, folder: str, store: Column | None = None, removals: DataFrame | None = None) -> int:
    """A scan and what follows from it; the number of new and changed files."""
    n = scan(spark, home, folder, store, removals)
    if folders.exists(spark, home.events):
        decide(spark, home).awaitTermination()
        folders.delete(spark, home.rows)  # all events are decided, and what was imported is among the entries
    return n


def compact(spark: SparkSession, home: Home) -> int:
    """Rewrites the files of periods from which reports have gone since the last time, without them; how many parts of periods those are.

    Only these periods are read. A part without a live row is deleted, the others replace themselves; the live view is the same before, meanwhile and after.
    """
    made = decisions(spark, home)
    numbered = made.filter("status = 'imported'").select("store", "number", "period_end")
    gone = numbered.join(made.select("store", F.explode("gone").alias("number")), ["store", "number"], "left_semi")
    todo = gone.join(_written(spark, home.compacted, "store string, number long"), ["store", "number"], "left_anti")
    todo = spark.createDataFrame(todo.collect(), "store string, number long, period_end date")  # a row for each report that has gone
    if todo.isEmpty():
        return 0
    schema = f"{_ENTRY}, scan long"
    touched = _written(spark, home.entries, schema).join(F.broadcast(todo.select("period_end").distinct()), "period_end", "left_semi")
    alive = touched.join(live(spark, home).select("store", "number"), ["store", "number"], "left_semi")
    parts = ["period_end", "batch", "scan"]
    empty = touched.select(*parts).distinct().join(alive.select(*parts).distinct(), parts, "left_anti").collect()
    count = touched.select(*parts).distinct().count()
    alive.select([c.split()[0] for c in schema.split(", ")]).hint("rebalance", "period_end").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(home.entries)
    for part in empty:
        folders.delete(spark, f"{home.entries}/" + "/".join(f"{p}={part[p]}" for p in parts))
    todo.select("store", "number").write.mode("append").parquet(home.compacted)
    return count
