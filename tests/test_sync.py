"""Folders of sheets kept in sync with a history."""

from __future__ import annotations

import os
import shutil
from datetime import date

import pandas as pd
from pyspark.sql import functions as F
from tallyframe.operators.store import Ledger
from tallyframe.streaming import activity, sync

HEAD = ["Item", "", "", "", "", "Opening Stock", "Purchase", "Purchase Free", "Other Receipt", "Sales", "Sales Free", "Other Issue", "", "Closing Stock", "Value"]


def sheet(folder, path, start, end, stamp, **skus):
    """A sheet of a period whose SKUs have a closing stock; ``stamp`` is its time."""
    period = " to ".join(date.fromisoformat(d).strftime("%d/%b/%Y") for d in (start, end))
    lines = [["Acme"], ["Here"], [f"Stock Statement from {period}"], HEAD, ["Brand"]]
    lines += [[k, "", "", "", "", "1", "0", "0", "0", "2", "0", "0", "", str(v), str(10 * v)] for k, v in skus.items()]
    file = folder / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text("\n".join("\t".join(x) for x in lines))
    os.utime(file, (stamp, stamp))


def live_rows(spark, home):
    return sorted((r["store"], str(r["period_start"]), r["sku"], r["closing_stock"]) for r in sync.live_history(spark, home).collect())


def moved(spark, home):
    """Last sale of each SKU from the state store, and by a recount of what is live (every row of a sheet has sales)."""
    activity.activity_stream(spark, home).awaitTermination()
    got = sorted((r["store"], r["sku"], r["last_purchase"], str(r["last_sale"])) for r in activity.last_activity(spark, home).collect())
    rows = sync.live_history(spark, home).groupBy("store", "sku").agg(F.max("period_end").alias("e")).collect()
    return got, sorted((r["store"], r["sku"], None, str(r["e"])) for r in rows)


def decided(spark, home):
    return {(r["scan"], r["event"], r["path"]): r["status"] for r in sync.decisions(spark, home).collect()}


def test_scans_replace_shrink_and_remove(spark, tmp_path):
    folder, home = tmp_path / "in", sync.Home(str(tmp_path / "home"))
    assert sync.refresh(spark, home, str(folder)) == 0
    sheet(folder, "a/may.xls", "2026-05-01", "2026-05-31", 1_000, x=5, y=6)
    sheet(folder, "a/june.xls", "2026-06-01", "2026-06-30", 1_000, x=7)
    sheet(folder, "b/july.xls", "2026-07-01", "2026-07-31", 1_000, x=1)
    (folder / "a" / "broken.xls").write_text("no\tsheet")
    (folder / "a" / "~$may.xls").write_text("lock")
    store = F.substring_index("path", "/", 1)
    assert sync.refresh(spark, home, str(folder), store) == 4
    assert live_rows(spark, home) == [("a", "2026-05-01", "x", 5), ("a", "2026-05-01", "y", 6), ("a", "2026-06-01", "x", 7), ("b", "2026-07-01", "x", 1)]
    assert sync.refresh(spark, home, str(folder), store) == 0  # nothing is opened again
    got, recount = moved(spark, home)
    assert got == recount and len(got) == 3
    sheet(folder, "a/may.xls", "2026-05-01", "2026-05-31", 2_000, y=8)  # changed: replaces its rows
    sheet(folder, "a/week.xls", "2026-06-10", "2026-06-16", 2_000, x=9)  # newer and overlapping: June goes
    sheet(folder, "b/again.xls", "2026-07-01", "2026-07-31", 2_000, x=3)  # the period of another live file
    drop = spark.createDataFrame([("b", date(2026, 7, 1), date(2026, 7, 31)), ("b", date(2026, 1, 1), date(2026, 1, 2))], "store string, period_start date, period_end date")
    assert sync.refresh(spark, home, str(folder), store, drop) == 3
    assert live_rows(spark, home) == [("a", "2026-05-01", "y", 8), ("a", "2026-06-10", "x", 9), ("b", "2026-07-01", "x", 3)]
    statuses = decided(spark, home)
    assert statuses[1, "file", "a/broken.xls"] == "error" and statuses[2, "file", "b/again.xls"] == "imported"
    assert sorted(r["status"] for r in sync.decisions(spark, home).filter("event = 'remove'").collect()) == ["not_found", "removed"]
    got, recount = moved(spark, home)
    assert got == recount and ("a", "x", None, "2026-06-16") in got
    assert activity.compact_activity(spark, home) > 0 and activity.compact_activity(spark, home) == 0
    assert moved(spark, home)[0] == recount
    assert sync.compact(spark, home) > 0
    assert live_rows(spark, home) == [("a", "2026-05-01", "y", 8), ("a", "2026-06-10", "x", 9), ("b", "2026-07-01", "x", 3)]
    left = spark.read.parquet(home.entries)
    assert left.count() == 3 and sync.compact(spark, home) == 0
    # the removed report's file and June's are forgotten, so they come again: July is there already, June replaces the week
    assert sync.refresh(spark, home, str(folder), store) == 2
    assert live_rows(spark, home) == [("a", "2026-05-01", "y", 8), ("a", "2026-06-01", "x", 7), ("b", "2026-07-01", "x", 3)]
    assert decided(spark, home)[3, "file", "b/july.xls"] == "duplicate_period"


def test_any_batches_give_one_fold(spark, tmp_path):
    folder, home, parted = tmp_path / "in", sync.Home(str(tmp_path / "home")), sync.Home(str(tmp_path / "parted"))
    steps = [
        ("a.xls", "2026-01-01", "2026-01-31", 1, {"x": 1}),
        ("c.xls", "2026-01-20", "2026-02-10", 2, {"x": 3}),
        ("a.xls", "2026-01-01", "2026-01-15", 3, {"x": 4, "y": 5}),
        ("c.xls", "2026-05-01", "2026-05-31", 4, {"y": 7}),
    ]
    plain, wanted = Ledger(), {}
    for n, (path, start, end, stamp, skus) in enumerate(steps):
        sheet(folder, path, start, end, stamp, **skus)
        sync.scan(spark, home, str(folder))
        for p in sorted(f.name for f in folder.iterdir()):
            own = next(s for s in reversed(steps[: n + 1]) if s[0] == p)
            status, number, gone, _ = plain.take(p, (folder / p).stat().st_size, own[3], False, len(own[4]), date.fromisoformat(own[1]), date.fromisoformat(own[2]))
            for g in gone:
                wanted.pop(g)
            if status == "imported":
                wanted[number] = [("main", own[1], k, float(v)) for k, v in own[4].items()]
    expected = sorted(r for rows in wanted.values() for r in rows)
    sync.decide(spark, home).awaitTermination()
    assert live_rows(spark, home) == expected
    assert "dynamicpruning" in sync.live_history(spark, home)._jdf.queryExecution().toString().lower()
    shutil.copytree(home.rows, parted.rows)
    for n in range(1, len(steps) + 1):
        shutil.copytree(f"{home.events}/{n}", f"{parted.events}/{n}")
        if n in (1, 3, 4):
            sync.decide(spark, parted).awaitTermination()
    assert live_rows(spark, parted) == expected


def test_repeated_items_add_up_and_rows_are_kept_once(spark, tmp_path):
    """An item that a sheet has twice is one row; rows that are among the entries are not kept a second time."""
    folder, home = tmp_path / "in", sync.Home(str(tmp_path / "home"))
    sheet(folder, "may.xls", "2026-05-01", "2026-05-31", 1_000, x=5, y=6)
    sheet(folder, "june.xls", "2026-06-01", "2026-06-30", 1_000, x=7)
    again = ["x", "", "", "", "", "1", "0", "0", "0", "2", "0", "0", "", "4", "40"]
    with (folder / "may.xls").open("a") as f:
        f.write("\n" + "\n".join("\t".join(x) for x in (["Other"], again)))
    os.utime(folder / "may.xls", (1_000, 1_000))
    assert sync.refresh(spark, home, str(folder)) == 2
    assert live_rows(spark, home) == [("main", "2026-05-01", "x", 9), ("main", "2026-05-01", "y", 6), ("main", "2026-06-01", "x", 7)]
    assert {r["brand"] for r in sync.live_history(spark, home).collect()} == {"Brand"}
    assert not os.path.exists(home.rows)


class Calls(dict):
    """A map state that counts what is asked of it."""

    made = 0

    def getValue(self, key):
        self.made += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.made += 1
        self[key] = value

    def removeKey(self, key):
        self.made += 1
        del self[key]


def test_activity_reads_and_writes_the_state_once_a_sku():
    state, dates = Calls(), activity.Dates()
    dates.init(type("Handle", (), {"getMapState": lambda *_: state})())
    run = lambda *rows: list(dates.handleInputRows(("main", 0), iter([pd.DataFrame(rows, columns=["sku", "number", "bought", "sold", "gone"])]), None))[0].values.tolist()
    none = -(2**31)
    assert run(*[("x", n, n if n % 2 else none, 100 + n, False) for n in range(50)], ("y", 3, none, 7, False)) == [["main", "x", 49, 149], ["main", "y", none, 7]]
    assert state.made == 4
    assert run(("x", 49, none, none, True), ("x", 60, none, 90, False), ("y", 3, none, 7, True)) == [["main", "x", 47, 148], ["main", "y", none, none]]
    assert state.made == 8 and list(state) == [("x",)]
