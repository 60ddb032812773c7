"""Cases on small frames: bounds, ties, empties and nulls of single operators."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tallyframe.functions.expressions import status
from tallyframe.operators import diagnostics, enriched, ingest, lookup, reports, rollups, segments, store, stores
from tallyframe.thresholds import Thresholds

SCHEMA = (
    "report_id int, period_start date, period_end date, period_days int, company string, location string, brand string, sku string, opening_stock double, purchase double, "
    "purchase_free double, other_receipt double, sales double, sales_free double, other_issue double, closing_stock double, value decimal(18,2)"
)


def row(report, start, end, sku="x", brand="b", value=10, **numbers):
    start, end = date.fromisoformat(start), date.fromisoformat(end)
    n = {k: float(numbers.get(k, 0)) for k in ("opening_stock", "purchase", "purchase_free", "other_receipt", "sales", "sales_free", "other_issue", "closing_stock")}
    return (report, start, end, (end - start).days + 1, "c", "l", brand, sku, *n.values(), Decimal(value))


def history(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def periods(spark, *pairs):
    rows = [(i, date.fromisoformat(a), date.fromisoformat(b)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "report_id int, period_start date, period_end date").withColumn("period_days", F.datediff("period_end", "period_start") + 1)


@pytest.mark.parametrize(
    ("closing", "dead", "cover", "returned", "expected"),
    [
        (5, False, 15.0, False, "healthy"),
        (5, False, 90.0, False, "healthy"),
        (5, False, 14.9, False, "low_stock"),
        (5, False, 90.1, False, "overstock"),
        (5, False, float("inf"), False, "overstock"),
        (5, True, 1.0, False, "dead_stock"),
        (5, True, 9999.0, False, "dead_stock"),
        (0, True, 1.0, False, "out_of_stock"),
        (-1, False, 1.0, True, "returned"),
    ],
)
def test_status(spark, closing, dead, cover, returned, expected):
    df = spark.createDataFrame([(float(closing), dead, cover, returned)], "closing_stock double, is_dead boolean, days_of_cover double, is_returned boolean")
    assert df.select(status(15, 90)).first()[0] == expected


def test_relabelled_brand_keeps_its_pace(spark):
    h = history(
        spark,
        row(1, "2026-05-01", "2026-05-31", brand="old", sales=30, closing_stock=9),
        row(2, "2026-06-01", "2026-06-30", brand="old", sales=30, closing_stock=9),
        row(3, "2026-07-01", "2026-07-31", brand="new", sales=40, closing_stock=9),
    )
    out = enriched.enriched(h, reports.scope(h, 90), Thresholds()).collect()
    assert [(r["brand"], r["trailing_sales"]) for r in out] == [("new", 100.0)]


@pytest.mark.parametrize(("first", "days"), [("2026-03-01", 152), ("2015-01-01", 750)])
def test_never_active_ages_from_the_first_report_or_the_lookback(spark, first, days):
    h = history(spark, row(1, first, (date.fromisoformat(first) + timedelta(9)).isoformat(), closing_stock=4), row(2, "2026-07-01", "2026-07-31", closing_stock=4))
    assert enriched.last_activity(h, reports.scope(h, 90), Thresholds()).first()["days_since_activity"] == days


def test_free_units_sold_count_and_free_receipts_do_not(spark):
    h = history(
        spark,
        row(1, "2026-01-01", "2026-01-31", sku="a", closing_stock=4),
        row(2, "2026-06-01", "2026-06-30", sku="a", sales_free=5, closing_stock=4),
        row(2, "2026-06-01", "2026-06-30", sku="b", purchase_free=5, closing_stock=4),
        row(3, "2026-07-01", "2026-07-31", sku="a", closing_stock=4),
        row(3, "2026-07-01", "2026-07-31", sku="b", closing_stock=4),
    )
    out = {r["sku"]: r for r in enriched.last_activity(h, reports.scope(h, 90), Thresholds()).collect()}
    assert out["a"]["days_since_activity"] == 31 and not out["a"]["is_dead"]
    assert out["b"]["days_since_activity"] == 211 and out["b"]["is_dead"]


def test_latest_report_tie_goes_to_the_later_start(spark):
    h = history(spark, row(1, "2025-08-01", "2026-07-31", closing_stock=1), row(2, "2026-07-01", "2026-07-31", closing_stock=2))
    s = reports.scope(h, 90)
    assert (s.latest_id, s.previous_id) == (2, 1)
    assert reports.scope(h.limit(0), 90) is None


@pytest.mark.parametrize(
    ("values", "a", "b", "tiers"),
    [((700, 200, 100), 70, 90, "ABC"), ((10000, 50), 70, 90, "AC"), ((10, 10, 10), 40, 70, "AAB"), ((0, 0), 70, 90, "CC"), ((5, -9), 70, 90, "CC"), ((), 70, 90, "")],
)
def test_value_tiers(spark, values, a, b, tiers):
    df = spark.createDataFrame([(f"s{i}", Decimal(v), 1.0) for i, v in enumerate(values)], "sku string, value decimal(18,2), closing_stock double")
    out = segments.value_tiers(df, Thresholds(tier_a_pct=a, tier_b_pct=b)).orderBy("sku").collect()
    assert "".join(r["tier"] for r in out) == tiers


def test_gaps_and_missing_months(spark):
    gap = reports.coverage_gaps(periods(spark, ("2026-01-01", "2026-01-31"), ("2026-02-05", "2026-02-28"))).collect()
    assert [tuple(r) for r in gap] == [(date(2026, 2, 1), date(2026, 2, 4), 4)]
    missing = reports.missing_months(periods(spark, ("2026-01-01", "2026-01-31"), ("2026-03-01", "2026-03-31"))).collect()
    assert [r["label"] for r in missing] == ["Feb 2026"]
    wide = periods(spark, ("2026-01-01", "2026-03-31"))
    assert not reports.missing_months(wide).collect() and not reports.coverage_gaps(wide).collect()
    assert not reports.missing_months(wide.limit(0)).collect() and not reports.coverage_gaps(wide.limit(0)).collect()


def test_stores_are_apart(spark):
    a, b = periods(spark, ("2026-01-01", "2026-01-31"), ("2026-03-01", "2026-03-31")), periods(spark, ("2026-02-01", "2026-02-28"))
    both = a.withColumn("location", F.lit("a")).unionByName(b.withColumn("location", F.lit("b")))
    gaps = [tuple(r) for r in reports.coverage_gaps(both, ("location",)).collect()]
    assert gaps == [("a", date(2026, 2, 1), date(2026, 2, 28), 28)]
    taken = {(r["location"], r["report_id"]): r["taken"] for r in reports.trailing_window(both, 30, ("location",)).collect()}
    assert taken == {("a", 0): False, ("a", 1): True, ("b", 0): True}
    log = _log(spark, ("import", "2026-06-01", "2026-06-30"), ("import", "2026-06-10", "2026-06-20"), ("import", "2026-06-15", "2026-06-16"))
    log = log.withColumn("location", F.when(F.col("seq") == 1, "b").otherwise("a"))
    assert sorted(r["seq"] for r in store.live_reports(log, ("location",)).collect()) == [1, 2]
    h = history(spark, row(1, "2026-06-01", "2026-06-30", sku="x", closing_stock=3), row(2, "2026-05-01", "2026-05-31", sku="y", closing_stock=4)).withColumn("location", F.when(F.col("report_id") == 1, "l").otherwise(None))
    out = reports.per_store(h, lambda own: enriched.current_snapshot(own, reports.scope(own, 90)))
    assert sorted((r["location"] or "", r["sku"]) for r in out.collect()) == [("", "y"), ("l", "x")]


def test_keyed_results_are_those_of_each_store_alone(spark):
    rows = [row(n, f"2026-0{n}-01", f"2026-0{n}-28", sku=f"s{i}", brand="b" if i % 3 else None, closing_stock=i % 4, value=7 * i, sales=(i + n) % 5, purchase=i % 2) for n in range(1, 7) for i in range(12)]
    where = F.when(F.substring("sku", 2, 9).cast("int") % 3 == 0, None).otherwise(F.concat(F.lit("l"), F.substring("sku", 2, 9).cast("int") % 3))
    h = history(spark, *rows).withColumn("location", where).filter("location is null or location <> 'l1' or report_id < 5")
    limits = Thresholds(trailing_days=60)
    keys = ("company", "location")
    alone = {
        "enriched": lambda own: enriched.enriched(own, reports.scope(own, 60), limits),
        "status": lambda own: rollups.status_rollup(enriched.enriched(own, reports.scope(own, 60), limits)),
        "tiers": lambda own: segments.value_tiers(enriched.enriched(own, reports.scope(own, 60), limits), limits),
        "leaders": lambda own: rollups.top_skus(enriched.enriched(own, reports.scope(own, 60), limits), "value", 3),
    }
    every = stores.enriched(h, limits)
    keyed = {"enriched": every, "status": stores.status_rollup(every), "tiers": stores.value_tiers(every, limits), "leaders": stores.top_skus(every, "value", 3)}
    for name, build in alone.items():
        one = reports.per_store(h, build)
        assert sorted(map(repr, keyed[name].select(*keys, *[c for c in one.columns if c not in keys]).collect())) == sorted(map(repr, one.select(*keyed[name].select(*keys, *[c for c in one.columns if c not in keys]).columns).collect())), name


def test_live_view_of_a_long_log_has_no_nested_loop(spark):
    n = 100_000
    log = spark.range(n).select(F.col("id").alias("seq"), F.lit("import").alias("event"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 7919 % 12_000).cast("int")).alias("period_start"))
    log = log.withColumn("period_end", F.date_add("period_start", (F.col("seq") % 3).cast("int")))
    live = store.live_reports(log)
    assert "NestedLoop" not in live._jdf.queryExecution().toString()
    covered, expected = set(), 0
    for seq in range(n - 1, -1, -1):
        days = range(seq * 7919 % 12_000, seq * 7919 % 12_000 + seq % 3 + 1)
        expected += not any(d in covered for d in days)
        covered.update(days)
    assert live.count() == expected


def test_trailing_gaps(spark):
    assert reports.trailing_gaps(periods(spark, ("2026-05-01", "2026-05-31"), ("2026-06-10", "2026-06-30")), 60).first()["days"] == 9
    far = periods(spark, ("2026-01-01", "2026-01-31"), ("2026-03-01", "2026-03-31"), ("2026-06-01", "2026-06-30"))
    assert not reports.trailing_gaps(far, 10).collect()


@pytest.mark.parametrize(("closing", "issue"), [(12, None), (12.3, None), (20, "stock does not balance by -8.0")])
def test_balance(spark, closing, issue):
    h = history(spark, row(1, "2026-01-01", "2026-01-31", opening_stock=10, purchase=5, sales=3, closing_stock=closing))
    assert [r["issue"] for r in diagnostics.quality_issues(h).collect()] == ([issue] if issue else [])


def test_negative_opening(spark):
    h = history(spark, row(1, "2026-01-01", "2026-01-31", opening_stock=-2, purchase=2))
    assert [r["issue"] for r in diagnostics.quality_issues(h).collect()] == ["negative opening stock"]


def test_duplicate_rows_add_up_and_keep_the_first_brand(spark):
    numbers = "opening_stock double, purchase double, purchase_free double, other_receipt double, sales double, sales_free double, other_issue double, closing_stock double, value double"
    rows = [("f", 3, None, "x", 4.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, 5.0, 50.0), ("f", 5, "b", "x", 10.0, 4.0, 0.0, 0.0, 4.0, 0.0, 0.0, 10.0, 100.0), ("f", 9, "z", "x", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    out = ingest.dedupe_entries(spark.createDataFrame(rows, f"file string, row_no int, brand string, sku string, {numbers}")).first()
    assert (out["brand"], out["opening_stock"], out["purchase"], out["sales"], out["closing_stock"], out["value"]) == ("b", 14, 6, 5, 15, 150)


def _log(spark, *events):
    rows = [(i, e, f"f{i}", date.fromisoformat(a), date.fromisoformat(b)) for i, (e, a, b) in enumerate(events)]
    return spark.createDataFrame(rows, "seq int, event string, filename string, period_start date, period_end date")


def test_newest_overlapping_import_survives_and_removal_forgets(spark):
    inside = _log(spark, ("import", "2026-06-01", "2026-06-30"), ("import", "2026-06-10", "2026-06-20"))
    across = _log(spark, ("import", "2026-06-01", "2026-06-30"), ("import", "2026-06-15", "2026-07-15"))
    assert [r["seq"] for r in store.live_reports(inside).collect()] == [1] == [r["seq"] for r in store.live_reports(across).collect()]
    gone = _log(spark, ("import", "2026-06-01", "2026-06-30"), ("remove", "2026-06-01", "2026-06-30"))
    assert not store.live_reports(gone).collect()
    again = _log(spark, ("import", "2026-06-01", "2026-06-30"), ("remove", "2026-06-01", "2026-06-30"), ("import", "2026-06-01", "2026-06-30"))
    assert [r["seq"] for r in store.live_reports(again).collect()] == [2]


def _catalog(spark, *rows):
    return spark.createDataFrame(list(rows), "code string, product_name string, long_name string")


def test_catalog_diff(spark):
    old = _catalog(spark, ("1", "a", "a long"), ("2", "b", None), ("3", "c", "c"))
    new = _catalog(spark, ("1", "a2", "a long 2"), ("2", "b", "b long"), ("3", "c", "c long"), ("9", "n", "n long"))
    out = store.catalog_renames(old, new).collect()
    assert [(r["seq"], r["old_name"], r["new_name"]) for r in out] == [(1, "a", "a2"), (2, "a long", "a long 2")]


def test_rename_pairing(spark):
    new, gone = (spark.createDataFrame([(s,) for s in x], "sku string") for x in (("n1", "n2"), ("o1", "o2", "o3")))
    aliases = spark.createDataFrame([("o1", "n1"), ("o2", "n1"), ("o3", "elsewhere")], "old_name string, new_name string")
    assert [tuple(r) for r in diagnostics.rename_pairs(new, gone, aliases).collect()] == [("o1", "n1")]
    assert not diagnostics.rename_pairs(new, gone, aliases.limit(0)).collect()


def test_paid_and_free_demand_give_one_cover(spark):
    h = history(
        spark,
        row(1, "2026-07-01", "2026-07-31", sku="a", sales=30, closing_stock=9),
        row(1, "2026-07-01", "2026-07-31", sku="b", sales=15, sales_free=15, closing_stock=9),
    )
    a, b = (r["days_of_cover"] for r in enriched.enriched(h, reports.scope(h, 30), Thresholds()).orderBy("sku").collect())
    assert a == b == 9 / (30 / 31)


def test_fixed_categories_are_complete(spark):
    h = history(spark, row(1, "2026-07-01", "2026-07-31", closing_stock=3, sales=3))
    e = enriched.enriched(h, reports.scope(h, 90), Thresholds())
    assert rollups.status_rollup(e).count() == 6 and rollups.dead_aging(e).count() == 4
    assert segments.segment_summary(segments.value_segments(e, Thresholds())).count() == 9
    assert rollups.status_rollup(e.limit(0)).agg(F.sum("sku_count")).first()[0] == 0


def test_unmatched_needs_a_catalog(spark):
    now = spark.createDataFrame([(" a ",), ("b",)], "sku string")
    names = spark.createDataFrame([("a",)], "name string")
    assert [r["sku"] for r in diagnostics.unmatched(now, names).collect()] == ["b"]
    assert not diagnostics.unmatched(now, names.limit(0)).collect()


def test_search_is_literal_and_needs_two_characters(spark):
    e = spark.createDataFrame([("50% off", None, 1.0, Decimal(1), "healthy"), ("505 off", "B", 1.0, Decimal(2), "healthy")], "sku string, brand string, closing_stock double, value decimal(18,2), status string")
    assert [r["sku"] for r in lookup.sku_search(e, " 0% ").collect()] == ["50% off"]
    assert not lookup.sku_search(e, "5").collect()


def test_file_classification(spark):
    day = date.fromisoformat
    rows = [
        ("s", 1, "a.xls", 1, 1, False, 3, day("2026-01-01"), day("2026-01-31")),
        ("s", 1, "b.xls", 1, 1, False, 3, day("2026-01-01"), day("2026-01-31")),
        ("s", 1, "c.xls", 1, 1, True, 3, None, None),
        ("s", 2, "a.xls", 1, 1, False, 3, day("2026-01-01"), day("2026-01-31")),
        ("s", 3, "a.xls", 2, 2, False, 3, day("2026-05-01"), day("2026-05-31")),
        ("s", 4, "a.xls", 3, 3, False, 3, day("2026-01-01"), day("2026-01-31")),
    ]
    df = spark.createDataFrame(rows, "store string, batch long, path string, size long, mtime long, failed boolean, n_rows long, period_start date, period_end date")
    out = [r["status"] for r in store.classify_files(df).orderBy("batch", "path").collect()]
    assert out == ["imported", "duplicate_period", "error", "unchanged", "filename_reused", "imported"]


FILE = "store string, batch long, path string, size long, mtime long, failed boolean, n_rows long, period_start date, period_end date"


class Folder:
    """What a folder scan does to reports and their files, step by step and by search instead of by index."""

    def __init__(self):
        self.files, self.reports, self.made = [], [], 0

    def scan(self, path, stamp, period):
        known = next((f for f in self.files if f["path"] == path), None)
        if known and known["stamp"] == stamp:
            return "unchanged"

        def note(report, status):
            self.files[:] = [f for f in self.files if f["path"] != path] + [{"path": path, "stamp": stamp, "report": report}]
            return status

        if period is None:
            return note(None, "error")
        overlap = lambda r: r["period"][0] <= period[1] and period[0] <= r["period"][1]
        own = next((r for r in self.reports if known and r["id"] == known["report"]), None)
        if own and own["period"] != period and not overlap(own):
            return note(own["id"], "filename_reused")
        twin = next((r for r in self.reports if r["period"] == period), None)
        if twin and not (own and own["id"] == twin["id"]):
            return note(twin["id"], "duplicate_period")
        for r in [r for r in self.reports if overlap(r)]:
            self.reports.remove(r)
            if r["period"] == period:
                self.files[:] = [{**f, "report": None} if f["report"] == r["id"] else f for f in self.files]
            else:
                self.files[:] = [f for f in self.files if f["report"] != r["id"]]
        self.made += 1
        self.reports.append({"id": self.made, "period": period})
        return note(self.made, "imported")


def test_file_classification_in_every_order_of_four_events(spark):
    from itertools import product

    day = date.fromisoformat
    may, june, part = (day("2026-05-01"), day("2026-05-31")), (day("2026-06-01"), day("2026-06-30")), (day("2026-06-10"), day("2026-07-05"))
    events = [("a.xls", may), ("a.xls", june), ("a.xls", None), ("b.xls", may), ("b.xls", part), ("b.xls", None)]
    rows, expected = [], {}
    for n, order in enumerate(product(range(len(events)), repeat=4)):
        folder = Folder()
        for step, e in enumerate(order):
            (path, period), stamp = events[e], step if step % 3 else 0
            expected[f"s{n}", step] = folder.scan(path, (stamp, stamp), period)
            rows.append((f"s{n}", step, path, stamp, stamp, period is None, 3, *(period or (None, None))))
    out = store.classify_files(spark.createDataFrame(rows, FILE).repartition(8, "store")).collect()
    assert {(r["store"], r["batch"]): r["status"] for r in out} == expected
    assert set(expected.values()) == {"unchanged", "error", "filename_reused", "duplicate_period", "imported"}


def test_import_guards(spark):
    day = date.fromisoformat
    june, part = (day("2026-06-01"), day("2026-06-30")), (day("2026-06-10"), day("2026-06-20"))
    rows = [("s", 1, *june, 3, False), ("s", 2, *june, 3, False), ("s", 3, *june, 3, True), ("s", 4, *part, 0, False), ("s", 5, None, part[1], 3, False), ("s", 6, *part, 3, False), ("s", 7, *june, 3, False), ("t", 8, *june, 3, False)]
    out = store.judge_imports(spark.createDataFrame(rows, "store string, seq long, period_start date, period_end date, n_rows long, replace boolean")).orderBy("seq").collect()
    assert [r["outcome"] for r in out] == ["accepted", "period_exists", "accepted", "no_rows", "no_period", "accepted", "accepted", "accepted"]


def test_uploads_with_repeated_codes_change_nothing(spark):
    old, new = _catalog(spark, ("1", "a", None)), _catalog(spark, ("1", "b", None), ("2", "c", None))
    assert sorted(r["product_name"] for r in store.uploaded(old, new).collect()) == ["b", "c"]
    assert [r["product_name"] for r in store.uploaded(old, new.unionByName(_catalog(spark, ("2", "d", None)))).collect()] == ["a"]
    assert not store.uploaded(old, new.limit(0)).collect()
    versions = old.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(4)))
    assert [store.snapshot(versions, v).count() for v in (0, 1, 3, 4, 9)] == [0, 1, 1, 2, 2]
    assert not store.catalog_meta(old.withColumn("imported_at", F.lit("2026-01-01")).limit(0)).collect()


def test_numbers_are_written_as_numbers(spark):
    cells = ["1", " 2.5 ", "nan", "NaN", "2f", "2d", "1e3", "-.5", "x", "", None, "0x10", "+7.", "1,000"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c3 string")
    out = [r["n"] for r in df.select("i", ingest._number("c3").alias("n")).orderBy("i").collect()]
    assert out == [1, 2.5, None, None, None, None, 1000, -0.5, None, None, None, None, 7, None]


def test_hidden_and_temporary_parts_are_no_candidates(spark):
    paths = ["a.xls", "x/b.XLSX", "~$a.xls", "~$x/a.xls", ".x/a.xls", "x/.a.xls", "x/a.txt"]
    out = store.candidate_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert [r["path"] for r in out.collect()] == ["a.xls", "x/b.XLSX"]


def test_numbering_across_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("v").alias("v"))
    out = {r["k"]: r["seq"] for r in store.numbered(rows, ["k"], 10).collect()}
    assert out == {k: k + 11 for k in range(500)}


def test_grid_from_text_and_lists_to_csv(spark, tmp_path):
    from tallyframe.sources import files

    head = ["Item", "", "", "", "", "Opening Stock", "Purchase", "Purchase Free", "Other Receipt", "Sales", "Sales Free", "Other Issue", "", "Closing Stock", "Value"]
    item = ['Thing "x"', "", "", "", "", "4", "oops", "0", "0", "1", "0", "0", "", "3", "30"]
    lines = [["Acme"], ["Town"], ["Stock Statement from 01/Jun/2026 to 30/Jun/2026"], head, ["Brand"], item, ["Sub Total", *item[1:]], [""]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join("\t".join(x) for x in lines))
    grid = files.read_grid(spark, str(tmp_path / "in"))
    rows = ingest.dedupe_entries(ingest.statement_rows(grid)).collect()
    assert [(r["sku"], r["brand"], r["purchase"], r["closing_stock"]) for r in rows] == [('Thing "x"', "Brand", 0.0, 3.0)]
    top = ingest.banner(grid).first()
    assert (top["company"], top["location"], top["period_days"]) == ("Acme", "Town", 30)
    h = history(spark, row(1, "2026-06-01", "2026-06-30", sku='q "x", y', closing_stock=3))
    files.export_lists(enriched.enriched(h, reports.scope(h, 90), Thresholds()), 30, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out" / "overstock")).collect()
    assert [(r["SKU"], r["Days of Cover"]) for r in back] == [('q "x", y', None)]
    files.write_history(h, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 1


def test_activity_stream_takes_late_files_and_none(spark, tmp_path):
    from tallyframe.streaming import jobs

    rows = [row(2, "2026-06-01", "2026-06-30", sku="a", sales=1), row(3, "2026-07-01", "2026-07-31", sku="a", purchase=2), row(1, "2026-05-01", "2026-05-31", sku="a", sales=5), row(1, "2026-05-01", "2026-05-31", sku="b", sales_free=1)]
    schema = history(spark, *rows).schema
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    run = lambda: jobs.activity_stream(spark, folder, schema, out, checkpoint).awaitTermination()
    run()
    assert jobs.latest_activity(spark, out).count() == 0
    for r in rows:
        history(spark, r).write.mode("append").parquet(folder)
        run()
    found = {r["sku"]: (r["last_purchase"], r["last_sale"]) for r in jobs.latest_activity(spark, out).collect()}
    assert found == {"a": (date(2026, 7, 31), date(2026, 6, 30)), "b": (None, date(2026, 5, 31))}


def test_settings_have_ranges():
    for bad in ({"low_stock_days": 0}, {"dead_stock_days": 3651}, {"tier_a_pct": 90, "tier_b_pct": 90}, {"tier_b_pct": 100}):
        with pytest.raises(ValueError):
            Thresholds(**bad)
