"""Last activity of every SKU, kept up to date when reports come, are replaced and are removed.

A maximum can't give back what it has taken in. The state store therefore holds, for each SKU, the dates of every live report in which it
moved; a change adds a report's dates or takes them out, and the maximum of what is left is written. Only SKUs of changed
reports are touched, and of the history only the periods of reports that have gone are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources import folders
from .sync import Home, stateful

ACTIVITY = "store string, sku string, last_purchase date, last_sale date"
#: So many groups of a store's SKUs are processed on their own; fixed for as long as a state lasts.
GROUPS = 4096
#: Days are counted from 1970; this stands for none. A report of a SKU is its number and the days of purchase and sale.
_NONE, _REPORT = -(2**31), struct.Struct("<qii")


class Dates(StatefulProcessor):
    """Some SKUs of one store: the days by report, one value for each SKU, which is read and written once in a batch."""

    def init(self, handle) -> None:
        self.dates = handle.getMapState("dates", "sku string", "reports binary")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        changes: dict[str, list[tuple[bool, int, int, int]]] = {}
        for part in rows:
            for sku, *change in zip(*(part[c].tolist() for c in ("sku", "gone", "number", "bought", "sold"))):
                changes.setdefault(sku, []).append(change)
        out = []
        for sku, found in changes.items():
            held = self.dates.getValue((sku,))
            reports = {n: (b, s) for n, b, s in _REPORT.iter_unpack(held[0])} if held else {}
            reports.update((n, (b, s)) for gone, n, b, s in found if not gone)
            for gone, n, _, _ in found:
                if gone:  # a report that came and went in one batch has gone
                    reports.pop(n, None)
            if reports:
                self.dates.updateValue((sku,), (b"".join(_REPORT.pack(n, *d) for n, d in reports.items()),))
            elif held:
                self.dates.removeKey((sku,))
            out.append((key[0], sku, *(max((d[i] for d in reports.values()), default=_NONE) for i in (0, 1))))
        yield pd.DataFrame(out, columns=["store", "sku", "last_purchase", "last_sale"])

    def close(self) -> None:
        pass


def activity_stream(spark: SparkSession, home: Home):
    """Takes all waiting changes of ``home`` into the state; each batch writes the SKUs that it touched to a folder of its own number."""
    quiet = stateful(spark)
    date = lambda c: F.when(F.col(c) != _NONE, F.date_from_unix_date(c)).alias(c)

    def save(batch: DataFrame, number: int) -> None:
        batch.select("store", "sku", date("last_purchase"), date("last_sale")).write.mode("overwrite").parquet(f"{home.activity}/batch={number}")

    days = lambda c: F.coalesce(F.unix_date(c), F.lit(_NONE)).alias(c)
    group: Column = F.pmod(F.xxhash64("sku"), F.lit(GROUPS)).alias("group")
    changes = quiet.readStream.schema("store string, sku string, number long, bought date, sold date, gone boolean").parquet(f"{home.changes}/*")
    state = changes.select("store", group, "sku", "number", days("bought"), days("sold"), "gone").groupBy("store", "group")
    state = state.transformWithStateInPandas(Dates(), "store string, sku string, last_purchase int, last_sale int", "Update", "none")
    return state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{home.checkpoint}-activity").trigger(availableNow=True).start()


def last_activity(spark: SparkSession, home: Home) -> DataFrame:
    """``(store, sku, last_purchase, last_sale)`` of all SKUs that have moved in a live report: the last word of all batches."""
    if not folders.exists(spark, home.activity):
        return spark.createDataFrame([], ACTIVITY)
    said = spark.read.schema(f"{ACTIVITY}, batch long").parquet(home.activity)
    last = said.groupBy("store", "sku").agg(F.max_by(F.struct("last_purchase", "last_sale"), "batch").alias("last"))
    return last.select("store", "sku", "last.*").filter("last_purchase is not null or last_sale is not null")


def compact_activity(spark: SparkSession, home: Home) -> int:
    """Merges the batches so far into the newest one's folder and deletes the others; how many are deleted.

    The merged folder is made beside them and takes the newest's place at the end: before that nothing has changed, and after it the older folders say
    nothing that it doesn't.
    """
    path, fs = folders.hadoop_path(spark, home.activity)
    batches = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)) if fs.exists(path) else []
    if len(batches) < 2:
        return 0
    newest, spare = f"{home.activity}/batch={batches[-1]}", f"{home.path}/activity-merged"
    last_activity(spark, home).write.mode("overwrite").parquet(spare)
    folders.delete(spark, newest)
    fs.rename(folders.hadoop_path(spark, spare)[0], folders.hadoop_path(spark, newest)[0])
    for n in batches[:-1]:
        folders.delete(spark, f"{home.activity}/batch={n}")
    return len(batches) - 1
