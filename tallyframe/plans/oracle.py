"""The same queries as DuckDB SQL over the given tables, written on their own."""

from __future__ import annotations

_BASE = """
periods AS (
  SELECT row_number() OVER (ORDER BY period_start) AS report_id, period_start, period_end, date_diff('day', period_start, period_end) + 1 AS period_days
  FROM (SELECT DISTINCT CASE WHEN year(l_shipdate) = 1995 THEN DATE '1995-01-01' ELSE date_trunc('month', l_shipdate)::DATE END AS period_start,
      CASE WHEN year(l_shipdate) = 1995 THEN DATE '1995-12-31' ELSE last_day(l_shipdate) END AS period_end FROM lineitem)),
flow AS (
  SELECT l_partkey AS pk, CASE WHEN year(l_shipdate) = 1995 THEN DATE '1995-01-01' ELSE date_trunc('month', l_shipdate)::DATE END AS period_start,
    sum(CASE WHEN l_partkey % 37 <> 6 AND l_returnflag IN ('N', 'A') THEN l_quantity ELSE 0 END) AS sales,
    sum(CASE WHEN l_partkey % 37 <> 6 AND l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS sales_free,
    sum(CASE WHEN l_partkey % 37 = 6 OR (l_returnflag = 'R' AND l_linestatus = 'O') THEN l_quantity ELSE 0 END) AS other_issue
  FROM lineitem GROUP BY 1, 2),
g0 AS (
  SELECT p.p_partkey AS pk, p.p_name, p.p_brand, p.p_retailprice, r.*, coalesce(f.sales, 0) AS sales, coalesce(f.sales_free, 0) AS sales_free,
    coalesce(f.other_issue, 0) AS other_issue, CASE WHEN p.p_partkey % 37 = 6 THEN 5 ELSE 5 + p.p_partkey % 12 * 8 END AS lot
  FROM part p CROSS JOIN periods r LEFT JOIN flow f ON f.pk = p.p_partkey AND f.period_start = r.period_start),
g1 AS (SELECT *, sales + sales_free + other_issue AS gone, sum(sales + sales_free + other_issue) OVER (PARTITION BY pk ORDER BY report_id) AS c1 FROM g0),
g2 AS (SELECT *, lot - 1 - c1 % lot AS closing, lot - 1 - (c1 - gone) % lot AS opening FROM g1),
g3 AS (
  SELECT *, closing - opening + gone AS received, (closing::DECIMAL(18,0) * p_retailprice::DECIMAL(12,2))::DECIMAL(18,2) AS worth FROM g2
  WHERE period_start NOT IN (DATE '1998-03-01', DATE '2001-09-01') AND (pk * 7 + report_id * 13) % 29 <> 0),
h AS (
  SELECT report_id, period_start, period_end, period_days, 'Acme Traders' AS company, 'Central Store' AS location,
    CASE WHEN pk % 211 = 5 THEN NULL WHEN pk % 10 = 3 AND period_start < DATE '2001-08-01' THEN p_brand || ' OLD' ELSE p_brand END AS brand,
    p_name || ' ' || pk || CASE WHEN pk % 50 = 7 AND period_start >= DATE '2001-11-01' THEN ' (NON)' ELSE '' END AS sku,
    opening::DOUBLE AS opening_stock, (CASE WHEN pk % 6 < 4 THEN received ELSE 0 END)::DOUBLE AS purchase,
    (CASE WHEN pk % 6 = 4 THEN received ELSE 0 END)::DOUBLE AS purchase_free, (CASE WHEN pk % 6 = 5 THEN received ELSE 0 END)::DOUBLE AS other_receipt,
    (CASE WHEN pk % 103 = 1 AND month(period_start) = 7 THEN -1 ELSE sales END)::DOUBLE AS sales, sales_free::DOUBLE AS sales_free, other_issue::DOUBLE AS other_issue,
    (CASE WHEN pk % 97 = 2 AND month(period_start) IN (6, 11) THEN 0 - closing ELSE closing END)::DOUBLE AS closing_stock,
    CASE WHEN pk % 101 = 3 THEN -worth ELSE worth END AS value
  FROM g3),
dim AS (SELECT DISTINCT report_id, period_start, period_end, period_days, company, location FROM h),
win AS (
  SELECT *, coalesce(sum(period_days) OVER (ORDER BY period_end DESC, period_start DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS days_before FROM dim),
sc AS (
  SELECT arg_max(report_id, (period_end, period_start)) AS latest_id, max(period_end) AS latest_end, arg_min(period_start, (period_end, period_start)) AS first_start,
    sum(CASE WHEN days_before < 90 THEN period_days END) AS trailing_days, max(period_end) - 750 AS since FROM win),
prev AS (SELECT report_id FROM dim ORDER BY period_end DESC, period_start DESC LIMIT 1 OFFSET 1)"""

_ENRICHED = """,
snap AS (SELECT brand, sku, closing_stock, value FROM h, sc WHERE report_id = latest_id),
pace AS (
  SELECT sku, arg_min(opening_stock, (h.period_end, h.period_start)) AS trailing_opening, sum(purchase + purchase_free + other_receipt) AS trailing_purchase,
    sum(sales) AS trailing_sales, sum(sales_free) AS trailing_sales_free, sum(other_issue) AS trailing_other_issue
  FROM h JOIN win USING (report_id) WHERE days_before < 90 GROUP BY sku),
act AS (
  SELECT sku, max(CASE WHEN purchase > 0 THEN period_end END) AS lp, max(CASE WHEN sales > 0 OR sales_free > 0 THEN period_end END) AS ls
  FROM h, sc WHERE period_end >= since GROUP BY sku),
en0 AS (
  SELECT s.sku, s.brand, s.closing_stock, s.value, coalesce(trailing_opening, 0) AS trailing_opening, coalesce(trailing_purchase, 0) AS trailing_purchase,
    coalesce(trailing_sales, 0) AS trailing_sales, coalesce(trailing_sales_free, 0) AS trailing_sales_free, coalesce(trailing_other_issue, 0) AS trailing_other_issue,
    coalesce(greatest(lp, ls), greatest(since, first_start)) AS last_activity, latest_end, trailing_days
  FROM snap s CROSS JOIN sc LEFT JOIN pace USING (sku) LEFT JOIN act USING (sku)),
en1 AS (
  SELECT *, (trailing_sales + trailing_sales_free) / trailing_days::DOUBLE AS daily_demand, date_diff('day', last_activity, latest_end) AS days_since_activity,
    trailing_sales + trailing_sales_free = 0 AND trailing_other_issue > 0 AS is_returned FROM en0),
en2 AS (SELECT *, CASE WHEN daily_demand > 0 THEN closing_stock / daily_demand END AS days_of_cover, days_since_activity >= 90 AS is_dead FROM en1),
en AS (
  SELECT sku, brand, closing_stock, value, trailing_opening, trailing_purchase, trailing_sales, trailing_sales_free, trailing_other_issue, daily_demand, days_of_cover,
    last_activity, days_since_activity, is_dead, is_returned,
    CASE WHEN closing_stock <= 0 THEN CASE WHEN is_returned THEN 'returned' ELSE 'out_of_stock' END WHEN is_dead THEN 'dead_stock'
      WHEN days_of_cover < 15 THEN 'low_stock' WHEN days_of_cover IS NULL OR days_of_cover > 90 THEN 'overstock' ELSE 'healthy' END AS status
  FROM en2),
tiers AS (
  SELECT sku, value, CASE WHEN total <= 0 THEN 'C' WHEN before * 100 < total * 70 THEN 'A' WHEN before * 100 < total * 90 THEN 'B' ELSE 'C' END AS tier
  FROM (SELECT sku, value, sum(value) OVER () AS total, coalesce(sum(value) OVER (ORDER BY value DESC, sku ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM en WHERE closing_stock > 0)),
seg AS (
  SELECT *, tier || '-' || movement AS segment FROM (
    SELECT en.sku, brand, closing_stock, en.value, status, days_of_cover, tier,
      CASE status WHEN 'dead_stock' THEN 'non_moving' WHEN 'overstock' THEN 'slow' WHEN 'low_stock' THEN 'fast' WHEN 'healthy' THEN 'fast' END AS movement
    FROM en JOIN tiers USING (sku)) WHERE movement IS NOT NULL)"""

_CATALOG = """,
cat AS (
  SELECT 'C' || pk AS code, v, brand, name AS product_name, CASE WHEN pk % 5 <> 0 THEN upper(name) || ' LONG' END AS long_name, mrp
  FROM (SELECT p_partkey AS pk, v, p_brand AS brand, p_retailprice AS mrp, p_name || ' ' || p_partkey || CASE WHEN v = 2 AND p_partkey % 50 = 7 THEN ' (NON)' ELSE '' END AS name
    FROM part, (VALUES (1), (2)) AS t(v) WHERE p_partkey % 61 <> 4)),
ren AS (
  SELECT row_number() OVER (ORDER BY code, kind) AS seq, code, old_name, new_name FROM (
    SELECT a.code, 0 AS kind, a.product_name AS old_name, b.product_name AS new_name FROM cat a JOIN cat b ON a.code = b.code AND a.v = 1 AND b.v = 2 WHERE a.product_name <> b.product_name
    UNION ALL SELECT a.code, 1, a.long_name, b.long_name FROM cat a JOIN cat b ON a.code = b.code AND a.v = 1 AND b.v = 2 WHERE a.long_name <> b.long_name AND a.long_name <> a.product_name)),
names AS (SELECT product_name AS name FROM cat WHERE v = 2 UNION SELECT long_name FROM cat WHERE v = 2 AND long_name IS NOT NULL),
alias AS (SELECT old_name, arg_max(new_name, seq) AS new_name FROM ren GROUP BY old_name),
now_ AS (SELECT sku, brand, closing_stock, value FROM h, sc WHERE report_id = latest_id),
then_ AS (SELECT sku, brand, closing_stock, value FROM h WHERE report_id = (SELECT report_id FROM prev)),
new0 AS (SELECT * FROM now_ WHERE sku NOT IN (SELECT sku FROM then_)),
gone0 AS (SELECT * FROM then_ WHERE sku NOT IN (SELECT sku FROM now_)),
pairs AS (
  SELECT min(g.sku) AS old_name, a.new_name FROM gone0 g JOIN alias a ON a.old_name = g.sku WHERE a.new_name IN (SELECT sku FROM new0) GROUP BY a.new_name)"""

_LOG = """,
log AS (
  SELECT report_id AS seq, 'import' AS event, 'report-' || report_id || '.xls' AS filename, period_start, period_end FROM dim
  UNION ALL VALUES (1001, 'import', 'june-again.xls', DATE '2000-06-01', DATE '2000-06-30'), (1002, 'import', 'june-part.xls', DATE '2000-06-10', DATE '2000-06-20'),
    (1003, 'remove', '', DATE '1997-05-01', DATE '1997-05-31')),
live AS (
  SELECT seq, filename, period_start, period_end FROM log l WHERE event = 'import' AND NOT EXISTS (
    SELECT 1 FROM log m WHERE m.seq > l.seq AND (m.event = 'import' AND m.period_start <= l.period_end AND m.period_end >= l.period_start
      OR m.event = 'remove' AND m.period_start = l.period_start AND m.period_end = l.period_end))),
ledger AS (
  SELECT seq, filename, CASE WHEN seq % 7 = 0 THEN 'error' WHEN seq % 11 = 0 THEN 'duplicate_period' ELSE 'imported' END AS status, period_end + 1 AS checked_at FROM log WHERE event = 'import'
  UNION ALL SELECT seq + 5000, filename, 'imported', period_end + 9 FROM log WHERE event = 'import' AND seq % 14 = 0),
ledger1 AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY filename ORDER BY checked_at DESC, seq DESC) = 1)"""

# What is live after two scans: every fifth sheet shrunk, June 2000 replaced by a part of it, May 1997 removed (unless its changed sheet came again).
_SYNCED_BASE = _BASE.replace("\nh AS (", "\nh_all AS (", 1).replace(
    "\ndim AS (",
    """
h AS (
  SELECT * FROM h_all WHERE (report_id % 5 <> 0 OR length(sku) % 2 = 0) AND NOT (period_start = DATE '1997-05-01' AND report_id % 5 <> 0) AND period_start <> DATE '2000-06-01'
  UNION ALL SELECT * REPLACE (1000 AS report_id, DATE '2000-06-10' AS period_start, DATE '2000-06-20' AS period_end, 11 AS period_days) FROM h_all
    WHERE period_start = DATE '2000-06-01' AND length(sku) % 3 = 0),
dim AS (""",
    1,
)

# The history dealt to fifty stores and the enriched SKUs of each, "location" naming a store.
_STORES = """,
st AS (
  SELECT * EXCLUDE (s, company, location), CASE WHEN s % 7 <> 0 THEN company END AS company, 'Store ' || s AS location
  FROM (SELECT *, regexp_extract(sku, '[0-9]+')::BIGINT % 50 AS s FROM h) WHERE report_id <= (SELECT max(report_id) FROM dim) - s % 3),
sdim AS (SELECT DISTINCT company, location, report_id, period_start, period_end, period_days FROM st),
swin AS (
  SELECT *, coalesce(sum(period_days) OVER (PARTITION BY location ORDER BY period_end DESC, period_start DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS days_before FROM sdim),
ssc AS (
  SELECT location, any_value(company) AS company, arg_max(report_id, (period_end, period_start)) AS latest_id, max(period_end) AS latest_end, arg_min(period_start, (period_end, period_start)) AS first_start,
    sum(CASE WHEN days_before < 90 THEN period_days END)::BIGINT AS trailing_days, max(period_end) - 750 AS since, count(*) AS reports FROM swin GROUP BY location),
space AS (
  SELECT st.location, sku, arg_min(opening_stock, (st.period_end, st.period_start)) AS trailing_opening, sum(purchase + purchase_free + other_receipt) AS trailing_purchase,
    sum(sales) AS trailing_sales, sum(sales_free) AS trailing_sales_free, sum(other_issue) AS trailing_other_issue
  FROM st JOIN swin USING (location, report_id) WHERE days_before < 90 GROUP BY ALL),
sact AS (
  SELECT location, sku, max(CASE WHEN purchase > 0 THEN period_end END) AS lp, max(CASE WHEN sales > 0 OR sales_free > 0 THEN period_end END) AS ls
  FROM st JOIN ssc USING (location) WHERE period_end >= since GROUP BY ALL),
sen0 AS (
  SELECT ssc.company, location, st.sku, brand, closing_stock, value, coalesce(trailing_opening, 0) AS trailing_opening, coalesce(trailing_purchase, 0) AS trailing_purchase,
    coalesce(trailing_sales, 0) AS trailing_sales, coalesce(trailing_sales_free, 0) AS trailing_sales_free, coalesce(trailing_other_issue, 0) AS trailing_other_issue,
    coalesce(greatest(lp, ls), greatest(since, first_start)) AS last_activity, latest_end, trailing_days
  FROM st JOIN ssc USING (location) LEFT JOIN space USING (location, sku) LEFT JOIN sact USING (location, sku) WHERE report_id = latest_id),
sen1 AS (
  SELECT *, (trailing_sales + trailing_sales_free) / trailing_days::DOUBLE AS daily_demand, date_diff('day', last_activity, latest_end) AS days_since_activity,
    trailing_sales + trailing_sales_free = 0 AND trailing_other_issue > 0 AS is_returned FROM sen0),
sen2 AS (SELECT *, CASE WHEN daily_demand > 0 THEN closing_stock / daily_demand END AS days_of_cover, days_since_activity >= 90 AS is_dead FROM sen1),
sen AS (
  SELECT company, location, sku, brand, closing_stock, value, trailing_opening, trailing_purchase, trailing_sales, trailing_sales_free, trailing_other_issue, daily_demand, days_of_cover,
    last_activity, days_since_activity, is_dead, is_returned,
    CASE WHEN closing_stock <= 0 THEN CASE WHEN is_returned THEN 'returned' ELSE 'out_of_stock' END WHEN is_dead THEN 'dead_stock'
      WHEN days_of_cover < 15 THEN 'low_stock' WHEN days_of_cover IS NULL OR days_of_cover > 90 THEN 'overstock' ELSE 'healthy' END AS status
  FROM sen2),
sowners AS (SELECT DISTINCT company, location FROM sen),
stiers AS (
  SELECT company, location, sku, value, CASE WHEN total <= 0 THEN 'C' WHEN before * 100 < total * 70 THEN 'A' WHEN before * 100 < total * 90 THEN 'B' ELSE 'C' END AS tier
  FROM (SELECT *, sum(value) OVER (PARTITION BY location) AS total, coalesce(sum(value) OVER (PARTITION BY location ORDER BY value DESC, sku ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sen WHERE closing_stock > 0)),
sseg AS (
  SELECT company, location, value, tier || '-' || movement AS segment FROM (
    SELECT sen.company, location, sen.value, tier,
      CASE status WHEN 'dead_stock' THEN 'non_moving' WHEN 'overstock' THEN 'slow' WHEN 'low_stock' THEN 'fast' WHEN 'healthy' THEN 'fast' END AS movement
    FROM sen JOIN stiers USING (location, sku)) WHERE movement IS NOT NULL),
sbrands AS (
  SELECT company, location, brand, total_value, row_number() OVER (PARTITION BY location ORDER BY total_value DESC, brand) AS n
  FROM (SELECT company, location, brand, sum(value)::DECIMAL(38,2) AS total_value FROM sen WHERE brand IS NOT NULL GROUP BY ALL))"""

_NUM = "opening_stock, purchase, purchase_free, other_receipt, sales, sales_free, other_issue, closing_stock, value::DOUBLE AS value"
_ISSUES = """,
gap AS (SELECT *, opening_stock + purchase + purchase_free + other_receipt - sales - sales_free - other_issue - closing_stock AS gap FROM h),
issues AS (
  SELECT report_id, period_end, sku, brand, 'negative value with stock' AS issue FROM gap WHERE closing_stock > 0 AND value < -0.01
  UNION ALL SELECT report_id, period_end, sku, brand, 'negative closing stock' FROM gap WHERE closing_stock < 0
  UNION ALL SELECT report_id, period_end, sku, brand, 'negative opening stock' FROM gap WHERE opening_stock < 0
  UNION ALL SELECT report_id, period_end, sku, brand, 'negative sales' FROM gap WHERE sales < 0
  UNION ALL SELECT report_id, period_end, sku, brand, 'stock does not balance by ' || printf('%+.1f', gap) FROM gap WHERE abs(gap) > 0.5)"""
_LABEL = "CASE WHEN strftime(period_start, '%b %Y') = strftime(period_end, '%b %Y') THEN strftime(period_start, '%b %Y') ELSE strftime(period_start, '%b %Y') || '–' || strftime(period_end, '%b %Y') END"
_GAPS = """
SELECT reached + 1 AS gap_start, period_start - 1 AS gap_end, date_diff('day', reached, period_start) - 1 AS days
FROM (SELECT period_start, max(period_end) OVER (ORDER BY period_start, period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {rows}) WHERE period_start > reached + 1"""
_LIST = "sku, brand, closing_stock, value, trailing_purchase, trailing_sales, days_of_cover, status"
_ROWS = "'report-' || report_id || '.xls' AS file"


_HEALTH = f"""
SELECT 'last_refresh' AS section, 1 AS rows
UNION ALL SELECT 'missing_months', count(*) FROM (SELECT unnest(generate_series(date_trunc('month', min(period_start)), date_trunc('month', max(period_end)), INTERVAL 1 MONTH)) AS month FROM live) m
  WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.period_start <= last_day(m.month) AND l.period_end >= m.month)
UNION ALL SELECT 'coverage_gaps', count(*) FROM ({_GAPS.format(rows="live")})
UNION ALL SELECT 'problem_files', least(count(*), 20) FROM ledger1 WHERE status <> 'imported'
UNION ALL SELECT 'item_catalog', 1
UNION ALL SELECT 'unmatched_skus', least(count(*), 100) FROM now_ WHERE trim(sku) NOT IN (SELECT name FROM names)
UNION ALL SELECT 'new_skus', least(count(*), 50) FROM new0 WHERE sku NOT IN (SELECT new_name FROM pairs)
UNION ALL SELECT 'vanished_skus', least(count(*), 50) FROM gone0 WHERE sku NOT IN (SELECT old_name FROM pairs)
UNION ALL SELECT 'likely_renames', count(*) FROM pairs
UNION ALL SELECT 'quality_issues', least(count(*), 100) FROM issues
UNION ALL SELECT 'quality_totals', count(DISTINCT CASE WHEN issue LIKE 'stock does not balance%' THEN 'stock does not balance' ELSE issue END) FROM issues"""


def _said(section: str, rows: str, number: str, *columns: str) -> str:
    item = " || '|' || ".join(f"coalesce({c}::VARCHAR, '')" for c in columns)
    return f"SELECT '{section}' AS section, {item} AS item, ({number})::BIGINT AS number FROM ({rows})"


_CHANGED = "SELECT *, count(*) OVER () AS total FROM {0} WHERE sku NOT IN (SELECT {1} FROM pairs) ORDER BY value DESC, sku LIMIT 50"
_HEALTH_CONTENTS = "\nUNION ALL ".join([
    _said("last_refresh", "SELECT max(checked_at) AS last_refresh FROM ledger", "NULL", "last_refresh"),
    _said("missing_months", "SELECT month::DATE AS month, strftime(month, '%b %Y') AS label FROM (SELECT unnest(generate_series(date_trunc('month', min(period_start)), date_trunc('month', max(period_end)), INTERVAL 1 MONTH)) AS month FROM live) m WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.period_start <= last_day(m.month) AND l.period_end >= m.month)", "NULL", "month", "label"),
    _said("coverage_gaps", _GAPS.format(rows="live"), "days", "gap_start", "gap_end"),
    _said("problem_files", "SELECT * FROM ledger1 WHERE status <> 'imported' ORDER BY checked_at DESC, filename LIMIT 20", "NULL", "filename", "status", "checked_at"),
    _said("item_catalog", "SELECT DATE '2026-08-02' AS imported_at, count(*) AS n FROM cat WHERE v = 2", "n", "imported_at"),
    _said("unmatched_skus", "SELECT *, count(*) OVER () AS total FROM now_ WHERE trim(sku) NOT IN (SELECT name FROM names) ORDER BY value DESC, sku LIMIT 100", "total", "brand", "sku", "value"),
    _said("new_skus", _CHANGED.format("new0", "new_name"), "total", "brand", "sku", "value"),
    _said("vanished_skus", _CHANGED.format("gone0", "old_name"), "total", "brand", "sku", "value"),
    _said("likely_renames", "SELECT * FROM pairs", "NULL", "old_name", "new_name"),
    _said("quality_issues", "SELECT * FROM issues ORDER BY period_end DESC, sku, issue LIMIT 100", "NULL", "report_id", "period_end", "sku", "issue"),
    _said("quality_totals", "SELECT CASE WHEN issue LIKE 'stock does not balance%' THEN 'stock does not balance' ELSE issue END AS kind, count(*) AS n FROM issues GROUP BY 1", "n", "kind"),
])


def _sql(body: str, *more: str) -> str:
    return "WITH " + _BASE.strip() + "".join(more) + "\n" + body.strip()


_E, _C, _L = _ENRICHED, _CATALOG, _LOG
_FIXED_STATUS = "(VALUES (0, 'out_of_stock'), (1, 'low_stock'), (2, 'dead_stock'), (3, 'overstock'), (4, 'healthy'), (5, 'returned')) AS f(position, status)"
_POLICY = """(VALUES (0, 'A-fast', 'Top priority — keep well stocked, review often.'),
  (1, 'A-slow', 'High value moving slowly — review before reordering; consider a smaller order quantity.'),
  (2, 'A-non_moving', 'High value tied up, not moving — review for return/markdown before it ages further.'),
  (3, 'B-fast', 'Standard reorder cadence, no special attention needed.'),
  (4, 'B-slow', 'Reduce reorder quantity; keep an eye on it.'),
  (5, 'B-non_moving', 'Worth a look — candidate for markdown or return.'),
  (6, 'C-fast', 'Low value, low risk — simplified reordering.'),
  (7, 'C-slow', 'Low-value long tail — reorder only on request, minimal review.'),
  (8, 'C-non_moving', 'Low-value dead stock — low priority, but a candidate to drop from the catalog.')) AS f(position, segment, policy)"""

ORACLES: dict[str, str] = {
    "report_dimension": _sql("SELECT * FROM dim"),
    "trailing_window": _sql("SELECT report_id, days_before, days_before < 90 AS taken FROM win"),
    "period_labels": _sql(f"SELECT report_id, period_start, period_end, {_LABEL} AS label FROM dim"),
    "fy_rollup": _sql("SELECT strftime(period_start - INTERVAL 3 MONTH, '%y') || strftime(period_start + INTERVAL 9 MONTH, '%y') AS fy, count(*) AS reports, min(period_start) AS first_start, max(period_end) AS last_end FROM dim GROUP BY 1"),
    "reports_by_fiscal_year": _sql("SELECT fy, row_number() OVER (PARTITION BY fy ORDER BY period_start, period_end)::INTEGER AS position, report_id, period_start, period_end FROM (SELECT *, strftime(period_start - INTERVAL 3 MONTH, '%y') || strftime(period_start + INTERVAL 9 MONTH, '%y') AS fy FROM dim)"),
    "history_meta": _sql("SELECT arg_max(company, (period_end, period_start)) AS company, arg_max(location, (period_end, period_start)) AS location, arg_min(period_start, (period_end, period_start)) AS earliest_period_start, max(period_end) AS latest_period_end, count(*) AS report_count, sum(CASE WHEN days_before < 90 THEN period_days END)::BIGINT AS trailing_days FROM win"),
    "coverage_gaps": _sql(_GAPS.format(rows="live"), _L),
    "trailing_gaps": _sql(_GAPS.format(rows="(SELECT * FROM win WHERE days_before < 90)")),
    "missing_months": _sql("SELECT m.month::DATE AS month, strftime(m.month, '%b %Y') AS label FROM (SELECT unnest(generate_series(date_trunc('month', min(period_start)), date_trunc('month', max(period_end)), INTERVAL 1 MONTH)) AS month FROM live) m WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.period_start <= last_day(m.month) AND l.period_end >= m.month)", _L),
    "current_snapshot": _sql("SELECT * FROM snap", _E),
    "trailing_agg": _sql("SELECT * FROM pace", _E),
    "dead_stock_flags": _sql("SELECT sku, last_activity, days_since_activity, is_dead FROM en", _E),
    "enriched_skus": _sql("SELECT * FROM en", _E),
    "enriched_from_sums": _sql("SELECT * FROM en", _E),
    "status_rollup": _sql(f"SELECT f.position, f.status, count(en.sku) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM {_FIXED_STATUS} LEFT JOIN en USING (status) GROUP BY 1, 2", _E),
    "kpis": _sql("SELECT count(*) AS sku_count, count(DISTINCT brand) AS brand_count, sum(value)::DECIMAL(38,2) AS total_value, sum(closing_stock) AS total_closing FROM en", _E),
    "top_brands": _sql("SELECT brand, sum(value)::DECIMAL(38,2) AS total_value FROM en WHERE brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", _E),
    "top_skus_value": _sql("SELECT sku, brand, closing_stock, value, trailing_sales FROM en ORDER BY value DESC, sku LIMIT 15", _E),
    "top_skus_sales": _sql("SELECT sku, brand, closing_stock, value, trailing_sales FROM en ORDER BY trailing_sales DESC, sku LIMIT 15", _E),
    **{f"list_{s}": _sql(f"SELECT {_LIST}{', days_since_activity' if s == 'dead_stock' else ''} FROM en WHERE status = '{s}'", _E) for s in ("out_of_stock", "low_stock", "dead_stock", "overstock")},
    "dead_aging": _sql("SELECT f.position, f.bucket, count(en.sku) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM (VALUES (0, '90-179', 90, 180), (1, '180-364', 180, 365), (2, '365-729', 365, 730), (3, '730+', 730, 1000000)) AS f(position, bucket, lo, hi) LEFT JOIN en ON status = 'dead_stock' AND days_since_activity >= lo AND days_since_activity < hi GROUP BY 1, 2", _E),
    "value_tiers": _sql("SELECT * FROM tiers", _E),
    "value_segments": _sql("SELECT * FROM seg", _E),
    "segment_summary": _sql(f"SELECT f.position, f.segment, f.policy, count(seg.sku) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM {_POLICY} LEFT JOIN seg USING (segment) GROUP BY 1, 2, 3", _E),
    "trend": _sql(f"SELECT report_id, period_start, period_end, {_LABEL} AS label, sum(value)::DECIMAL(38,2) AS total_value, sum(sales) AS total_sales FROM h GROUP BY ALL"),
    "trend_top_brands": _sql("SELECT b.brand, d.report_id, coalesce(sum(sales), 0) AS total_sales FROM (SELECT brand FROM en WHERE brand IS NOT NULL GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 5) b CROSS JOIN dim d LEFT JOIN h ON h.brand = b.brand AND h.report_id = d.report_id GROUP BY 1, 2", _E),
    "quality_issues": _sql("SELECT * FROM issues", _ISSUES),
    "quality_first": _sql("SELECT * FROM issues ORDER BY period_end DESC, sku, issue LIMIT 100", _ISSUES),
    "quality_totals": _sql("SELECT CASE WHEN issue LIKE 'stock does not balance%' THEN 'stock does not balance' ELSE issue END AS kind, count(*) AS issues FROM issues GROUP BY 1", _ISSUES),
    "sku_churn_new": _sql("SELECT *, count(*) OVER () AS total FROM new0 WHERE sku NOT IN (SELECT new_name FROM pairs) ORDER BY value DESC, sku LIMIT 50", _C),
    "sku_churn_vanished": _sql("SELECT *, count(*) OVER () AS total FROM gone0 WHERE sku NOT IN (SELECT old_name FROM pairs) ORDER BY value DESC, sku LIMIT 50", _C),
    "rename_pairs": _sql("SELECT * FROM pairs", _C),
    "unmatched_skus": _sql("SELECT brand, sku, closing_stock, value FROM now_ WHERE trim(sku) NOT IN (SELECT name FROM names)", _C),
    "unmatched_first": _sql("SELECT brand, sku, closing_stock, value, count(*) OVER () AS total FROM now_ WHERE trim(sku) NOT IN (SELECT name FROM names) ORDER BY value DESC, sku LIMIT 100", _C),
    "sku_search": _sql("SELECT sku, brand, closing_stock, value, status FROM en WHERE contains(lower(coalesce(brand, '')), 'ring 1') OR contains(lower(sku), 'ring 1') ORDER BY value DESC, sku LIMIT 50", _E),
    "sku_history": _sql("SELECT report_id, period_start, period_end, brand, sku, opening_stock, purchase, sales, closing_stock, value FROM h WHERE sku = 'small ring 0'"),
    "brand_history": _sql("SELECT report_id, period_start, period_end, sum(value)::DECIMAL(38,2) AS total_value, sum(sales) AS total_sales FROM h WHERE brand = 'Brand#2' GROUP BY 1, 2, 3"),
    "sku_detail": _sql("SELECT en.*, segment FROM en LEFT JOIN (SELECT sku, segment FROM seg) s USING (sku) WHERE sku = 'small ring 0'", _E),
    "brand_detail": _sql("SELECT sku, brand, closing_stock, value, status FROM en WHERE brand = 'Brand#2'", _E),
    "brand_totals": _sql("SELECT count(*) AS sku_count, sum(value)::DECIMAL(38,2) AS total_value, sum(closing_stock) AS total_closing FROM en WHERE brand = 'Brand#2'", _E),
    "table_page": _sql("SELECT sku, brand, value, days_of_cover, status FROM en WHERE contains(lower(sku), 'widget') OR contains(lower(coalesce(brand, '')), 'widget') ORDER BY days_of_cover ASC NULLS LAST, sku LIMIT 300", _E),
    "grid_to_tidy": _sql(f"SELECT {_ROWS}, sku, brand, {_NUM} FROM h"),
    "grid_banner": _sql(f"SELECT {_ROWS}, company, location, period_start, period_end, period_days FROM dim"),
    "header_check": _sql(f"SELECT {_ROWS}, 3 AS header_row, true AS ok FROM dim UNION ALL SELECT 'bad.xls', 3, false"),
    "dedupe_entries": _sql(f"SELECT {_ROWS}, sku, brand, " + ", ".join(f"{c} * (CASE WHEN h.opening_stock > 20 THEN 2 ELSE 1 END) AS {c}" for c in ("opening_stock", "purchase", "purchase_free", "other_receipt", "sales", "sales_free", "other_issue", "closing_stock")) + ", value::DOUBLE * (CASE WHEN h.opening_stock > 20 THEN 2 ELSE 1 END) AS value FROM h"),
    "item_list_to_tidy": _sql("SELECT 'items.xls' AS file, code, brand, product_name, '10''S' AS packing, '3004' AS hsn, long_name, mrp, NULL::DOUBLE AS by_rate, 12.0::DOUBLE AS tax_pct FROM cat WHERE v = 2", _C),
    "item_list_banner": _sql("SELECT 'items.xls' AS file, DATE '2026-08-09' AS as_of"),
    "catalog_renames": _sql("SELECT * FROM ren", _C),
    "catalog_rollback": _sql("SELECT * FROM ren WHERE seq <= 5", _C),
    "duplicate_codes": _sql("SELECT code, count(*) AS times FROM cat WHERE v = 2 OR substr(code, 2)::BIGINT % 13 = 3 GROUP BY 1 HAVING count(*) > 1", _C),
    "catalog_upload": _sql("SELECT CASE v WHEN 2 THEN 'clean' ELSE 'repeated' END AS upload, code, product_name FROM cat", _C),
    "catalog_restore": _sql("SELECT 'uploaded' AS step, 'item' AS kind, code, product_name AS name FROM cat WHERE v = 2 UNION ALL SELECT 'uploaded', 'rename', code, new_name FROM ren UNION ALL SELECT 'rolled back', 'item', code, product_name FROM cat WHERE v = 1", _C),
    "catalog_snapshot": _sql("SELECT code, brand, product_name, long_name, mrp FROM cat WHERE v = 1", _C),
    "catalog_meta": _sql("SELECT DATE '2026-08-02' AS imported_at, count(*) AS item_count FROM cat WHERE v = 2", _C),
    "import_health": _sql(_HEALTH, _L, _C, _ISSUES),
    "import_health_contents": _sql(_HEALTH_CONTENTS, _L, _C, _ISSUES),
    "alias_map": _sql("SELECT * FROM alias", _C),
    "catalog_names": _sql("SELECT * FROM names", _C),
    "live_reports": _sql("SELECT * FROM live", _L),
    "overlaps": _sql("SELECT * FROM live WHERE period_start <= DATE '2000-07-10' AND period_end >= DATE '2000-05-20'", _L),
    "exact_period": _sql("SELECT * FROM live WHERE period_start = DATE '2000-06-10' AND period_end = DATE '2000-06-20'", _L),
    "filename_conflicts": _sql("SELECT l.filename, l.period_start, l.period_end, i.a AS new_start, i.b AS new_end FROM live l JOIN (SELECT filename, period_start + (CASE WHEN seq % 2 = 0 THEN 400 ELSE 3 END) AS a, period_end + (CASE WHEN seq % 2 = 0 THEN 400 ELSE 3 END) AS b FROM log WHERE event = 'import' AND seq < 1000) i USING (filename) WHERE l.period_start > i.b OR l.period_end < i.a", _L),
    "report_listing": _sql("SELECT d.report_id, d.period_start, d.period_end, d.period_days, count(h.sku) AS sku_count FROM dim d LEFT JOIN (SELECT * FROM h WHERE report_id <> 20) h USING (report_id) GROUP BY ALL"),
    "ledger_latest": _sql("SELECT * FROM ledger1", _L),
    "problem_files": _sql("SELECT * FROM ledger1 WHERE status <> 'imported' ORDER BY checked_at DESC, filename LIMIT 20", _L),
    "last_refresh": _sql("SELECT max(checked_at) AS last_refresh FROM ledger", _L),
    "candidate_files": _sql("SELECT '2526/' || upper(filename) AS path FROM log WHERE event = 'import' AND seq % 4 = 3", _L),
    "incremental_equals_full": _sql("SELECT report_id, count(*) AS row_count, sum(value)::DECIMAL(38,2) AS total_value FROM h GROUP BY 1"),
    "export_lists": _sql(f"SELECT status AS list, {_LIST} FROM en WHERE status IN ('out_of_stock', 'low_stock', 'dead_stock', 'overstock')", _E),
    "export_summary": _sql(f"SELECT f.position, f.status, count(en.sku) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM {_FIXED_STATUS} LEFT JOIN en USING (status) GROUP BY 1, 2", _E),
    "json_edge": _sql("SELECT sku, brand, round(closing_stock)::BIGINT AS closing_stock, round(value::DOUBLE, 2) AS value, round(trailing_sales)::BIGINT AS trailing_sales, round(days_of_cover, 1) AS days_of_cover, status FROM en", _E),
    "store_history_meta": _sql("SELECT company, location, first_start AS earliest_period_start, latest_end AS latest_period_end, reports AS report_count, trailing_days FROM ssc", _STORES),
    "store_enriched_skus": _sql("SELECT * FROM sen", _STORES),
    "store_status_rollup": _sql(f"SELECT o.company, o.location, f.position, f.status, count(sen.sku) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM sowners o CROSS JOIN {_FIXED_STATUS} LEFT JOIN sen ON sen.location = o.location AND sen.status = f.status GROUP BY ALL", _STORES),
    "store_kpis": _sql("SELECT company, location, count(*) AS sku_count, count(DISTINCT brand) AS brand_count, sum(value)::DECIMAL(38,2) AS total_value, sum(closing_stock) AS total_closing FROM sen GROUP BY ALL", _STORES),
    "store_top_brands": _sql("SELECT company, location, brand, total_value FROM sbrands WHERE n <= 10", _STORES),
    "store_top_skus": _sql("SELECT company, location, sku, brand, closing_stock, value, trailing_sales FROM sen QUALIFY row_number() OVER (PARTITION BY location ORDER BY value DESC, sku) <= 15", _STORES),
    "store_list_dead_stock": _sql(f"SELECT company, location, {_LIST}, days_since_activity FROM sen WHERE status = 'dead_stock'", _STORES),
    "store_dead_aging": _sql("SELECT o.company, o.location, f.position, f.bucket, count(sen.sku) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM sowners o CROSS JOIN (VALUES (0, '90-179', 90, 180), (1, '180-364', 180, 365), (2, '365-729', 365, 730), (3, '730+', 730, 1000000)) AS f(position, bucket, lo, hi) LEFT JOIN sen ON sen.location = o.location AND status = 'dead_stock' AND days_since_activity >= lo AND days_since_activity < hi GROUP BY ALL", _STORES),
    "store_value_tiers": _sql("SELECT * FROM stiers", _STORES),
    "store_segment_summary": _sql(f"SELECT o.company, o.location, f.position, f.segment, f.policy, count(sseg.segment) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM (SELECT DISTINCT company, location FROM sseg) o CROSS JOIN {_POLICY} LEFT JOIN sseg ON sseg.location = o.location AND sseg.segment = f.segment GROUP BY ALL", _STORES),
    "store_trend": _sql(f"SELECT company, location, report_id, period_start, period_end, {_LABEL} AS label, sum(value)::DECIMAL(38,2) AS total_value, sum(sales) AS total_sales FROM st GROUP BY ALL", _STORES),
    "store_trend_top_brands": _sql("SELECT b.company, b.location, b.brand, d.report_id, coalesce(sum(sales), 0) AS total_sales FROM sbrands b JOIN sdim d USING (location) LEFT JOIN st ON st.location = b.location AND st.brand = b.brand AND st.report_id = d.report_id WHERE n <= 5 GROUP BY ALL", _STORES),
    "sync_history": "WITH " + _SYNCED_BASE.strip() + " SELECT 'main' AS store, period_start, period_end, brand, sku, opening_stock, purchase, purchase_free, other_receipt, sales, sales_free, other_issue, closing_stock, value FROM h",
    "sync_status_rollup": "WITH " + _SYNCED_BASE.strip() + _E + f" SELECT f.position, f.status, count(en.sku) AS sku_count, coalesce(sum(value), 0)::DECIMAL(38,2) AS total_value FROM {_FIXED_STATUS} LEFT JOIN en USING (status) GROUP BY 1, 2",
    "sync_last_activity": "WITH " + _SYNCED_BASE.strip() + " SELECT * FROM (SELECT 'main' AS store, sku, max(CASE WHEN purchase > 0 THEN period_end END) AS last_purchase, max(CASE WHEN sales > 0 OR sales_free > 0 THEN period_end END) AS last_sale FROM h GROUP BY 2) WHERE last_purchase IS NOT NULL OR last_sale IS NOT NULL",
    "sync_decisions": _sql("""SELECT 1 AS scan, 'file' AS event, 'imported' AS status, count(*) AS events, 0::BIGINT AS gone FROM dim
UNION ALL SELECT 2, 'remove', 'removed', 1, 1 UNION ALL SELECT 2, 'file', 'imported', 1 + count(*) FILTER (report_id % 5 = 0), 1 + count(*) FILTER (report_id % 5 = 0 AND period_start <> DATE '1997-05-01') FROM dim"""),
    "stream_ingest": _sql(f"SELECT {_ROWS}, sku, brand, {_NUM}, company, location, period_start, period_end, period_days FROM h"),
    "stream_last_activity": _sql("SELECT sku, max(CASE WHEN purchase > 0 THEN period_end END) AS last_purchase, max(CASE WHEN sales > 0 OR sales_free > 0 THEN period_end END) AS last_sale FROM h GROUP BY 1"),
}
