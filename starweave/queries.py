"""Registered queries over the TPC-H-like tables, each with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave import samples
from starweave.operators import catalog, estate, lineage, scoring, timeintel, validation
from starweave.operators.review import translations
from starweave.plans import rowcontext, stored
from starweave.plans.dax import parse
from starweave.plans.metricview import MetricView, qualified

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


STAR = """lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey"""
MONTHS = f"SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS m, sum(l.l_extendedprice) AS v FROM {STAR} GROUP BY 1"


def tidy(rows: DataFrame, names: dict[str, str], digits: dict[str, int] | None = None) -> DataFrame:
    """Columns renamed; doubles rounded, to 2 places unless told otherwise."""
    kinds = dict(rows.dtypes)
    value = lambda c, new: F.round(F.col(f"`{c}`"), (digits or {}).get(new, 2)) if kinds[c] == "double" else F.col(f"`{c}`")
    return rows.select(*[value(c, new).alias(new) for c, new in names.items()])


def view_query(name: str, dims: dict[str, str], measures: dict[str, str], sql: str, where: str | None = None, digits: dict[str, int] | None = None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = samples.view(spark, sf_dir, **options).query(list(dims), list(measures), where)
        return tidy(rows, dims | measures, digits)

    QUERIES[name], SQL[name] = run, sql


view_query("revenue_by_region", {"Region": "region"}, {"Total Revenue": "revenue"}, f"SELECT r.r_name AS region, round(sum(l.l_extendedprice), 2) AS revenue FROM {STAR} GROUP BY 1")
view_query("revenue_grand_total", {}, {"Total Revenue": "revenue", "Lines": "n_lines"}, "SELECT round(sum(l_extendedprice), 2) AS revenue, count(*) AS n_lines FROM lineitem")
view_query(
    "basic_aggregates_by_segment", {"Segment": "segment"},
    {"Quantity": "quantity", "Average Discount": "avg_discount", "Lowest Price": "low", "Highest Price": "high", "Lines": "n_lines", "Suppliers": "suppliers", "Customers": "customers"},
    f"""SELECT c.c_mktsegment AS segment, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS avg_discount, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high,
    count(*) AS n_lines, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS customers FROM {STAR} GROUP BY 1""", digits={"avg_discount": 6},
)
view_query("revenue_per_unit_by_brand", {"Brand": "brand"}, {"Revenue per Unit": "per_unit"}, f"SELECT p.p_brand AS brand, round(coalesce(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 0), 4) AS per_unit FROM {STAR} GROUP BY 1", digits={"per_unit": 4})
view_query("derived_discount_by_nation", {"Nation": "nation"}, {"Discount Given": "given"}, f"SELECT n.n_name AS nation, round(sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount)), 2) AS given FROM {STAR} GROUP BY 1")
view_query(
    "filtered_measures_by_region", {"Region": "region"}, {"Returned Revenue": "returned", "Open Revenue": "open", "Big Lines": "big"},
    f"""SELECT r.r_name AS region, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 2) AS returned, round(sum(l_extendedprice) FILTER (WHERE l_linestatus IN ('O')), 2) AS open,
    count(*) FILTER (WHERE l_quantity >= 40) AS big FROM {STAR} GROUP BY 1""",
)
view_query(
    "filter_reaches_composed_measures", {"Region": "region"}, {"Returned Net Share": "share"},
    f"""SELECT r.r_name AS region, round(sum(l_extendedprice * (1 - l_discount)) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.02) / nullif(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.02), 0), 6) AS share FROM {STAR} GROUP BY 1""", digits={"share": 6},
)
view_query("weighted_price_iterator", {"l_returnflag": "flag"}, {"Weighted Price": "weighted"}, "SELECT l_returnflag AS flag, round(sum(l_quantity * l_extendedprice), 2) AS weighted FROM lineitem GROUP BY 1")
view_query("average_order_two_levels", {"Segment": "segment"}, {"Average Order Revenue": "per_order"}, f"SELECT segment, round(avg(v), 4) AS per_order FROM (SELECT c.c_mktsegment AS segment, l_orderkey, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1, 2) GROUP BY 1", digits={"per_order": 4})
view_query("variables_and_switch", {"Nation": "nation"}, {"Revenue Band": "band"}, f"SELECT n.n_name AS nation, CASE WHEN sum(l_extendedprice) / nullif(count(*), 0) > 25000 THEN 'high' WHEN sum(l_extendedprice) / nullif(count(*), 0) > 20000 THEN 'mid' ELSE 'low' END AS band FROM {STAR} GROUP BY 1")
view_query("share_of_total", {"Region": "region"}, {"Share of Regions": "share"}, f"SELECT region, round(v / sum(v) OVER (), 6) AS share FROM (SELECT r.r_name AS region, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1)", digits={"share": 6})
view_query("share_within_region", {"Region": "region", "Nation": "nation"}, {"Share within Region": "share"}, f"SELECT region, nation, round(v / sum(v) OVER (PARTITION BY region), 6) AS share FROM (SELECT r.r_name AS region, n.n_name AS nation, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1, 2)", digits={"share": 6})
view_query(
    "non_additive_total", {"Region": "region", "Segment": "segment"}, {"Suppliers": "suppliers", "Suppliers Everywhere": "everywhere"},
    f"SELECT a.region, a.segment, a.suppliers, b.everywhere FROM (SELECT r.r_name AS region, c.c_mktsegment AS segment, count(DISTINCT l_suppkey) AS suppliers FROM {STAR} GROUP BY 1, 2) a LEFT JOIN (SELECT c.c_mktsegment AS segment, count(DISTINCT l_suppkey) AS everywhere FROM {STAR} GROUP BY 1) b ON a.segment IS NOT DISTINCT FROM b.segment",
)
view_query("all_ignores_the_filter", {"Nation": "nation"}, {"Total Revenue": "revenue", "Share of Everything": "share"}, f"SELECT n.n_name AS nation, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS share FROM {STAR} WHERE r.r_name = 'ASIA' GROUP BY 1", where='region[r_name] = "ASIA"', digits={"share": 6})
view_query("filtered_by_consumer", {"Order Year": "year"}, {"Total Revenue": "revenue"}, f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS revenue FROM {STAR} WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND l_quantity > 10 GROUP BY 1", where='customer[c_mktsegment] IN {"BUILDING", "MACHINERY"} && lineitem[l_quantity] > 10')
view_query("base_filter", {"l_linestatus": "status"}, {"Total Revenue": "revenue", "Lines": "n_lines"}, "SELECT l_linestatus AS status, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n_lines FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1", base_filter="lineitem[l_discount] >= 0.05")
view_query("inner_star_join", {"Region": "region"}, {"Total Revenue": "revenue"}, f"SELECT r.r_name AS region, round(sum(l_extendedprice), 2) AS revenue FROM {STAR.replace('LEFT', 'INNER')} GROUP BY 1", join="inner")
view_query("role_playing_nations", {"Nation": "customer_nation", "Supplier Nation": "supplier_nation"}, {"Total Revenue": "revenue"}, f"SELECT n.n_name AS customer_nation, sn.n_name AS supplier_nation, round(sum(l_extendedprice), 2) AS revenue FROM {STAR} GROUP BY 1, 2")
view_query(
    "another_relationship", {"Order Year": "year"}, {"Total Revenue": "ordered", "Revenue Shipped": "shipped"},
    f"SELECT a.year, a.ordered, b.shipped FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS ordered FROM {STAR} GROUP BY 1) a LEFT JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1) b USING (year)",
)
view_query("revenue_prior_year", {"Order Month": "month"}, {"Total Revenue": "revenue", "Revenue Prior Year": "prior"}, f"WITH x AS ({MONTHS}) SELECT a.m AS month, round(a.v, 2) AS revenue, round(b.v, 2) AS prior FROM x a LEFT JOIN x b ON b.m = CAST(a.m - INTERVAL 12 MONTH AS DATE)")
view_query("revenue_prior_and_next_month", {"Order Month": "month"}, {"Revenue Prior Month": "prior", "Revenue Next Month": "next"}, f"WITH x AS ({MONTHS}) SELECT a.m AS month, round(b.v, 2) AS prior, round(c.v, 2) AS next FROM x a LEFT JOIN x b ON b.m = CAST(a.m - INTERVAL 1 MONTH AS DATE) LEFT JOIN x c ON c.m = CAST(a.m + INTERVAL 1 MONTH AS DATE)")
view_query("revenue_to_date", {"Order Month": "month"}, {"Revenue YTD": "ytd", "Revenue QTD": "qtd"}, f"WITH x AS ({MONTHS}) SELECT m AS month, round(sum(v) OVER (PARTITION BY year(m) ORDER BY m), 2) AS ytd, round(sum(v) OVER (PARTITION BY year(m), quarter(m) ORDER BY m), 2) AS qtd FROM x")
view_query("revenue_yoy", {"Order Month": "month"}, {"Revenue YoY": "change", "Revenue YoY Pct": "pct"}, f"WITH x AS ({MONTHS}) SELECT a.m AS month, round(a.v - b.v, 2) AS change, round((a.v - b.v) / nullif(b.v, 0), 6) AS pct FROM x a LEFT JOIN x b ON b.m = CAST(a.m - INTERVAL 12 MONTH AS DATE)", digits={"pct": 6})
view_query("revenue_yoy_by_year_and_region", {"Order Year": "year", "Region": "region"}, {"Revenue Prior Year": "prior"}, f"WITH x AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, r.r_name AS g, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1, 2) SELECT a.y AS year, a.g AS region, round(b.v, 2) AS prior FROM x a LEFT JOIN x b ON b.y = a.y - 1 AND a.g IS NOT DISTINCT FROM b.g")
view_query("revenue_rolling_3m", {"Order Month": "month"}, {"Revenue Rolling 3M": "rolling"}, f"WITH x AS ({MONTHS}) SELECT m AS month, round(sum(v) OVER (ORDER BY m RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW), 2) AS rolling FROM x")
view_query("ratio_to_date", {"Order Quarter": "quarter"}, {"Net Share YTD": "share"}, f"WITH x AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, sum(l_extendedprice * (1 - l_discount)) AS a, sum(l_extendedprice) AS b FROM {STAR} GROUP BY 1) SELECT q AS quarter, round(sum(a) OVER w / nullif(sum(b) OVER w, 0), 6) AS share FROM x WINDOW w AS (PARTITION BY year(q) ORDER BY q)", digits={"share": 6})
view_query("revenue_between_dates", {"Region": "region"}, {"Revenue 1996": "revenue"}, f"SELECT r.r_name AS region, round(sum(l_extendedprice) FILTER (WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'), 2) AS revenue FROM {STAR} GROUP BY 1")
view_query("virtual_relationship", {"l_returnflag": "flag"}, {"Supplier Nation Revenue": "revenue"}, "SELECT l_returnflag AS flag, round(sum(l_extendedprice), 2) AS revenue FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
view_query("concatenated_values", {"Segment": "segment"}, {"Flags": "flags", "First Order": "first_order", "Last Order": "last_order"}, f"SELECT c.c_mktsegment AS segment, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags, min(CAST(o_orderdate AS DATE)) AS first_order, max(CAST(o_orderdate AS DATE)) AS last_order FROM {STAR} GROUP BY 1")
view_query("second_fact_orders", {"Segment": "segment"}, {"Order Total": "total", "Orders": "orders", "Customers Ordering": "customers"}, "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", fact="orders")
view_query("third_fact_events", {"event_type": "kind"}, {"Events": "events", "Event Value": "total", "Blank Values": "blank", "Users": "users"}, "SELECT event_type AS kind, count(*) AS events, round(sum(value), 2) AS total, count(*) FILTER (WHERE value IS NULL) AS blank, count(DISTINCT user_id) AS users FROM events GROUP BY 1", fact="events")


PRIOR = "SELECT a.m AS month, round(a.v, 2) AS revenue, round(b.v, 2) AS prior FROM x a LEFT JOIN x b ON b.m = CAST(a.m - INTERVAL 12 MONTH AS DATE)"
DAYS = f"SELECT CAST(o.o_orderdate AS DATE) AS d, sum(l.l_extendedprice) AS v FROM {STAR} GROUP BY 1"
# Leaves at their own table's grain, and several facts in one query.
CUSTOMERS = "customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"
ORDERED = f"orders o LEFT JOIN {CUSTOMERS.replace('customer c', 'customer c ON o.o_custkey = c.c_custkey')}"


def side_by_side(keys: list[str], names: list[str], parts: dict[str, str]) -> str:
    """SQL that stitches subqueries with the same keys: one row for each key that any of them has."""
    rows = " UNION ALL ".join(f"SELECT {', '.join([*keys, *[c if c in cols.split() else f'NULL AS {c}' for c in names]])} FROM ({part})" for part, cols in parts.items())
    return f"SELECT {', '.join([*keys, *[f'max({c}) AS {c}' for c in names]])} FROM ({rows}) GROUP BY {', '.join(keys)}"


view_query(
    "balance_by_region", {"Region": "region"},
    {"Balance": "balance", "Average Balance": "average", "Lowest Balance": "low", "Highest Balance": "high", "Customers on File": "customers", "Customers in Credit": "in_credit", "Balance by Nation Number": "weighed", "Segments on File": "segments"},
    f"""SELECT r.r_name AS region, round(sum(c_acctbal), 2) AS balance, round(avg(c_acctbal), 4) AS average, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high, count(*) AS customers,
    count(*) FILTER (WHERE c_acctbal > 5000) AS in_credit, round(sum(c_acctbal * n_nationkey), 2) AS weighed, count(DISTINCT c_mktsegment) + max(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS segments FROM {CUSTOMERS} GROUP BY 1""", digits={"average": 4},
)
view_query(
    "several_facts_by_region", {"Region": "region"},
    {"Total Revenue": "revenue", "Order Total": "order_total", "Urgent Orders": "urgent", "Balance": "balance", "Supplier Balance": "supplier_balance", "Revenue per Balance": "ratio"},
    f"""SELECT *, round(revenue / balance, 6) AS ratio, (SELECT round(sum(s_acctbal), 2) FROM supplier) AS supplier_balance FROM ({side_by_side(["region"], ["revenue", "order_total", "urgent", "balance"], {
        f"SELECT r.r_name AS region, round(sum(l_extendedprice), 2) AS revenue FROM {STAR} GROUP BY 1": "revenue",
        f"SELECT r.r_name AS region, round(sum(o_totalprice), 2) AS order_total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM {ORDERED} GROUP BY 1": "order_total urgent",
        f"SELECT r.r_name AS region, round(sum(c_acctbal), 2) AS balance FROM {CUSTOMERS} GROUP BY 1": "balance",
    })})""", digits={"ratio": 6},
)
view_query(
    "several_facts_by_year", {"Order Year": "year", "Segment": "segment"}, {"Lines": "n_lines", "Orders": "orders", "Order Total Prior Year": "prior", "Balance": "balance", "Balance Prior Year": "balance_prior"},
    f"""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {ORDERED} GROUP BY 1, 2),
    l AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS segment, count(*) AS n_lines FROM {STAR} GROUP BY 1, 2), b AS (SELECT c_mktsegment AS segment, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1),
    k AS (SELECT year, segment FROM o UNION SELECT year, segment FROM l)
    SELECT k.year, k.segment, l.n_lines, o.orders, p.total AS prior, b.balance, b.balance AS balance_prior FROM k LEFT JOIN l ON l.year IS NOT DISTINCT FROM k.year AND l.segment IS NOT DISTINCT FROM k.segment
    LEFT JOIN o ON o.year IS NOT DISTINCT FROM k.year AND o.segment IS NOT DISTINCT FROM k.segment LEFT JOIN o p ON p.year = k.year - 1 AND p.segment IS NOT DISTINCT FROM k.segment LEFT JOIN b ON b.segment IS NOT DISTINCT FROM k.segment""",
)
view_query(
    "filters_that_reach", {"Nation": "nation"}, {"Balance": "balance", "Balance of Returners": "returners", "Balance Everywhere": "everywhere", "Balance of Everyone": "everyone", "Suppliers on File": "suppliers"},
    f"""SELECT n.n_name AS nation, round(sum(c_acctbal), 2) AS balance, round(sum(c_acctbal), 2) AS returners, round(sum(c_acctbal), 2) AS everywhere,
    (SELECT round(sum(c_acctbal), 2) FROM customer) AS everyone, (SELECT count(*) FROM supplier) AS suppliers FROM {CUSTOMERS} WHERE r_name = 'ASIA' AND c_acctbal > 0 GROUP BY 1""",
    where='region[r_name] = "ASIA" && customer[c_acctbal] > 0 && part[p_size] > 10',
)
view_query("balance_by_brand", {"Brand": "brand"}, {"Lines": "n_lines", "Balance": "balance"}, f"SELECT p_brand AS brand, count(*) AS n_lines, (SELECT round(sum(c_acctbal), 2) FROM customer) AS balance FROM {STAR} GROUP BY 1")
view_query("balance_of_segments", {"Region": "region"}, {"Balance of Segments": "balance"}, f"SELECT k.region, round(avg(v), 2) AS balance FROM (SELECT DISTINCT r.r_name AS region FROM {STAR}) k LEFT JOIN (SELECT r.r_name AS region, c_mktsegment, sum(c_acctbal) AS v FROM {CUSTOMERS} GROUP BY 1, 2) b ON b.region IS NOT DISTINCT FROM k.region GROUP BY 1")
view_query("lines_seen_from_orders", {"Segment": "segment"}, {"Orders": "orders", "Total Revenue": "revenue"}, side_by_side(["segment"], ["orders", "revenue"], {
    f"SELECT c_mktsegment AS segment, count(*) AS orders FROM {ORDERED} GROUP BY 1": "orders", f"SELECT c_mktsegment AS segment, round(sum(l_extendedprice), 2) AS revenue FROM {STAR} GROUP BY 1": "revenue"}), fact="orders")

# Open-ended contexts: everything up to the last visible value.
BY_MONTH = f"SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS ym, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS m, sum(l.l_extendedprice) AS v, max(l_extendedprice) AS high, sum(l_discount) AS d, count(l_discount) AS n FROM {STAR} GROUP BY 1, 2"
view_query(
    "cumulative_by_filter", {"Order Month": "month"},
    {"Revenue to Now": "by_filter", "Revenue to Now by Variable": "by_variable", "Revenue to Now by Bounds": "by_bounds", "Revenue before Now": "before", "Highest Price to Now": "high", "Average Discount YTD": "discount", "Revenue YTD by Filter": "ytd"},
    f"""WITH x AS ({BY_MONTH}) SELECT m AS month, round(sum(v) OVER w, 2) AS by_filter, round(sum(v) OVER w, 2) AS by_variable, round(sum(v) OVER w, 2) AS by_bounds,
    round(sum(v) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS before, round(max(high) OVER w, 2) AS high,
    round(sum(d) OVER y / sum(n) OVER y, 8) AS discount, round(sum(v) OVER y, 2) AS ytd FROM x WINDOW w AS (ORDER BY m), y AS (PARTITION BY year(m) ORDER BY m)""", digits={"discount": 8},
)
view_query(
    "cumulative_by_region_and_year", {"Region": "region", "Order Year": "year"}, {"Revenue to Now": "revenue", "Orders to Now": "orders", "Revenue to Now a Year Ago": "year_ago"},
    f"""WITH x AS (SELECT r.r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1, 2), o AS (SELECT r.r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM {ORDERED} GROUP BY 1, 2),
    k AS (SELECT region, year FROM x UNION SELECT region, year FROM o),
    s AS (SELECT k.region, k.year, sum(v) OVER w AS v, sum(n) OVER w AS n FROM k LEFT JOIN x ON x.region IS NOT DISTINCT FROM k.region AND x.year = k.year LEFT JOIN o ON o.region IS NOT DISTINCT FROM k.region AND o.year = k.year WINDOW w AS (PARTITION BY k.region ORDER BY k.year))
    SELECT a.region, a.year, round(a.v, 2) AS revenue, CAST(a.n AS BIGINT) AS orders, round(b.v, 2) AS year_ago FROM s a LEFT JOIN s b ON b.region IS NOT DISTINCT FROM a.region AND b.year = a.year - 1""",
)
view_query("cumulative_under_date_filter", {"Order Month": "month"}, {"Revenue to Now": "revenue"}, f"WITH x AS ({BY_MONTH}) SELECT month, revenue FROM (SELECT m AS month, round(sum(v) OVER (ORDER BY m), 2) AS revenue FROM x) WHERE year(month) >= 1996 AND month(month) <> 2", where="'Date'[Year] >= 1996 && 'Date'[Month] <> 2")
view_query("trailing_days_by_filter", {"Order Day": "day"}, {"Revenue 90 Days by Filter": "revenue"}, f"WITH x AS ({DAYS}) SELECT d AS day, round(sum(v) OVER (ORDER BY d RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW), 2) AS revenue FROM x")
view_query(
    "suppliers_by_day_to_date", {"Order Day": "day", "Region": "region"}, {"Suppliers YTD": "ytd", "Suppliers to Now": "ever"},
    f"""WITH k AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, r.r_name AS g FROM {STAR}), f AS (SELECT r.r_name AS g, l_suppkey AS s, year(o_orderdate) AS y, min(CAST(o_orderdate AS DATE)) AS d FROM {STAR} GROUP BY 1, 2, 3),
    e AS (SELECT g, s, min(d) AS d FROM f GROUP BY 1, 2), ny AS (SELECT d, g, count(*) AS n FROM f GROUP BY 1, 2), ne AS (SELECT d, g, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT k.d AS day, k.g AS region, CAST(sum(coalesce(ny.n, 0)) OVER (PARTITION BY k.g, year(k.d) ORDER BY k.d) AS BIGINT) AS ytd, CAST(sum(coalesce(ne.n, 0)) OVER (PARTITION BY k.g ORDER BY k.d) AS BIGINT) AS ever
    FROM k LEFT JOIN ny ON ny.d = k.d AND ny.g IS NOT DISTINCT FROM k.g LEFT JOIN ne ON ne.d = k.d AND ne.g IS NOT DISTINCT FROM k.g""",
)
view_query(
    "suppliers_by_customer_to_date", {"c_custkey": "customer", "Order Month": "month"}, {"Suppliers YTD": "ytd"},
    f"""WITH x AS (SELECT c_custkey AS c, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, l_suppkey AS s FROM {STAR}), f AS (SELECT c, s, year(m) AS y, min(m) AS m FROM x GROUP BY 1, 2, 3), n AS (SELECT c, m, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT k.c AS customer, k.m AS month, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY k.c, year(k.m) ORDER BY k.m) AS BIGINT) AS ytd FROM (SELECT DISTINCT c, m FROM x) k LEFT JOIN n ON n.c IS NOT DISTINCT FROM k.c AND n.m = k.m""",
)
view_query(
    "customers_to_date", {"Order Month": "month"}, {"Customers to Date": "customers", "Order Total YTD": "total"},
    """WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_custkey AS c, o_totalprice AS v FROM orders), f AS (SELECT c, year(m) AS y, min(m) AS m FROM x WHERE c IS NOT NULL GROUP BY 1, 2), n AS (SELECT m, count(*) AS n FROM f GROUP BY 1),
    k AS (SELECT m, max(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS blank, sum(v) AS v FROM x GROUP BY 1)
    SELECT k.m AS month, CAST(sum(coalesce(n, 0)) OVER w + max(blank) OVER w AS BIGINT) AS customers, round(sum(v) OVER w, 2) AS total FROM k LEFT JOIN n ON n.m = k.m WINDOW w AS (PARTITION BY year(k.m) ORDER BY k.m)""", fact="orders",
)
view_query("revenue_up_to_size", {"p_size": "size"}, {"Total Revenue": "revenue", "Revenue up to Size": "up_to"}, f"WITH x AS (SELECT p_size AS s, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1) SELECT s AS size, round(v, 2) AS revenue, CASE WHEN s IS NOT NULL THEN round(sum(v) FILTER (WHERE s IS NOT NULL) OVER (ORDER BY s), 2) END AS up_to FROM x")
view_query("lines_up_to_price", {"Region": "region", "p_retailprice": "price"}, {"Lines up to Price": "n_lines"}, f"WITH x AS (SELECT r.r_name AS g, p_retailprice AS p, count(*) AS n FROM {STAR} GROUP BY 1, 2) SELECT g AS region, round(p, 2) AS price, CASE WHEN p IS NOT NULL THEN CAST(sum(n) FILTER (WHERE p IS NOT NULL) OVER (PARTITION BY g ORDER BY p) AS BIGINT) END AS n_lines FROM x")
# Several contexts, one scan of the facts.
view_query(
    "four_contexts", {"Order Month": "month"}, {"Total Revenue": "revenue", "Revenue YTD": "ytd", "Share of Everything": "share", "Revenue YoY": "change"},
    f"WITH x AS ({MONTHS}) SELECT a.m AS month, round(a.v, 2) AS revenue, round(sum(a.v) OVER (PARTITION BY year(a.m) ORDER BY a.m), 2) AS ytd, round(a.v / sum(a.v) OVER (), 8) AS share, round(a.v - b.v, 2) AS change FROM x a LEFT JOIN x b ON b.m = CAST(a.m - INTERVAL 12 MONTH AS DATE)", digits={"share": 8},
)
view_query(
    "distinct_contexts", {"Region": "region", "Order Year": "year"}, {"Lines": "n_lines", "Suppliers": "suppliers", "Suppliers YTD": "ytd", "Suppliers to Now": "ever", "Suppliers Everywhere": "everywhere", "Share within Region": "share"},
    f"""WITH x AS (SELECT r.r_name AS g, CAST(year(o_orderdate) AS INTEGER) AS y, l_suppkey AS s, l_extendedprice AS v FROM {STAR}), a AS (SELECT g, y, count(*) AS n, count(DISTINCT s) AS suppliers, sum(v) AS v FROM x GROUP BY 1, 2),
    e AS (SELECT y, count(DISTINCT s) AS everywhere FROM x GROUP BY 1), f AS (SELECT g, s, min(y) AS y FROM x GROUP BY 1, 2), n AS (SELECT g, y, count(*) AS n FROM f WHERE s IS NOT NULL GROUP BY 1, 2)
    SELECT a.g AS region, a.y AS year, a.n AS n_lines, a.suppliers, a.suppliers AS ytd, CAST(sum(coalesce(n.n, 0)) OVER (PARTITION BY a.g ORDER BY a.y) AS BIGINT) AS ever, e.everywhere, round(a.v / sum(a.v) OVER (PARTITION BY a.g), 6) AS share
    FROM a LEFT JOIN e USING (y) LEFT JOIN n ON n.g IS NOT DISTINCT FROM a.g AND n.y = a.y""", digits={"share": 6},
)
# Filters that cross a relationship from its many side.
view_query(
    "customers_who_ordered", {"Order Year": "year", "Segment": "segment"}, {"Customers Who Ordered": "customers", "Balance of the Urgent": "urgent"},
    f"""WITH k AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS c FROM orders), u AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT'),
    a AS (SELECT year, c_mktsegment AS segment, count(*) AS customers FROM k JOIN customer ON c = c_custkey GROUP BY 1, 2), b AS (SELECT year, c_mktsegment AS segment, round(sum(c_acctbal), 2) AS urgent FROM u JOIN customer ON c = c_custkey GROUP BY 1, 2)
    SELECT a.year, a.segment, a.customers, b.urgent FROM a LEFT JOIN b ON b.year IS NOT DISTINCT FROM a.year AND b.segment IS NOT DISTINCT FROM a.segment""",
)
view_query(
    "balance_of_buyers", {"Brand": "brand"}, {"Balance of Buyers": "balance", "Order Total over Lines": "total", "Orders over Lines": "orders", "Lines": "n_lines"},
    f"""WITH b AS (SELECT brand, round(sum(c_acctbal), 2) AS balance FROM (SELECT DISTINCT p_brand AS brand, o_custkey AS c FROM {STAR}) JOIN customer ON c = c_custkey GROUP BY 1),
    o AS (SELECT brand, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM (SELECT DISTINCT p_brand AS brand, l_orderkey AS k FROM {STAR}) JOIN orders ON k = o_orderkey GROUP BY 1), l AS (SELECT p_brand AS brand, count(*) AS n_lines FROM {STAR} GROUP BY 1)
    SELECT l.brand, b.balance, o.total, o.orders, l.n_lines FROM l LEFT JOIN b ON b.brand IS NOT DISTINCT FROM l.brand LEFT JOIN o ON o.brand IS NOT DISTINCT FROM l.brand""",
)
view_query(
    "filters_from_the_many_side", {"Segment": "segment"}, {"Balance of Buyers": "balance", "Customers Who Ordered": "customers", "Balance": "all_balance"},
    f"""WITH b AS (SELECT DISTINCT o_custkey AS c FROM {STAR} WHERE p_size > 45 AND o_orderdate >= TIMESTAMP '1997-01-01'), k AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
    SELECT c_mktsegment AS segment, round(sum(c_acctbal) FILTER (WHERE c_custkey IN (SELECT c FROM b)), 2) AS balance, count(*) FILTER (WHERE c_custkey IN (SELECT c FROM k)) AS customers, round(sum(c_acctbal), 2) AS all_balance FROM customer GROUP BY 1""",
    where="part[p_size] > 45 && 'Date'[Year] >= 1997",
)
view_query("first_and_last_orders", {"Segment": "segment"}, {"First Order": "first_order", "Last Order": "last_order"}, f"SELECT c_mktsegment AS segment, min(CAST(o_orderdate AS DATE)) AS first_order, max(CAST(o_orderdate AS DATE)) AS last_order FROM {ORDERED} GROUP BY 1")


view_query("prior_year_under_base_filter", {"Order Month": "month"}, {"Total Revenue": "revenue", "Revenue Prior Year": "prior"}, f"WITH x AS ({MONTHS.replace('GROUP BY', chr(32) + 'WHERE l.l_returnflag = ' + chr(39) + 'R' + chr(39) + ' GROUP BY')}) {PRIOR}", base_filter='lineitem[l_returnflag] = "R"')
view_query("prior_year_under_date_filter", {"Order Month": "month"}, {"Total Revenue": "revenue", "Revenue Prior Year": "prior"}, f"WITH x AS ({MONTHS}) {PRIOR} WHERE year(a.m) = 1997", where="'Date'[Year] = 1997")
view_query(
    "prior_year_of_half_years", {"Order Year": "year"}, {"Total Revenue": "revenue", "Revenue Prior Year": "prior"},
    f"WITH x AS (SELECT CAST(year(d) AS INTEGER) AS y, sum(v) AS v FROM ({DAYS}) WHERE month(d) >= 7 GROUP BY 1) SELECT a.y AS year, round(a.v, 2) AS revenue, round(b.v, 2) AS prior FROM x a LEFT JOIN x b ON b.y = a.y - 1", where="'Date'[Month] >= 7",
)
view_query("year_to_date_under_date_filter", {"Order Month": "month"}, {"Revenue YTD": "ytd"}, f"WITH x AS ({MONTHS}) SELECT month, ytd FROM (SELECT m AS month, round(sum(v) OVER (PARTITION BY year(m) ORDER BY m), 2) AS ytd FROM x) WHERE month(month) >= 6", where="'Date'[Month] >= 6")
view_query("average_over_filtered_values", {"Segment": "segment"}, {"Large Order Average": "per_order"}, f"SELECT segment, round(avg(v) FILTER (WHERE v > 100000), 4) AS per_order FROM (SELECT c.c_mktsegment AS segment, l_orderkey, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1, 2) GROUP BY 1", digits={"per_order": 4})
view_query("revenue_of_big_orders", {"Segment": "segment"}, {"Revenue of Big Orders": "revenue"}, f"SELECT segment, round(sum(v) FILTER (WHERE n >= 6), 2) AS revenue FROM (SELECT c.c_mktsegment AS segment, l_orderkey, sum(l_extendedprice) AS v, count(*) AS n FROM {STAR} GROUP BY 1, 2) GROUP BY 1")
view_query("rolling_30_days", {"Order Month": "month"}, {"Revenue Last 30 Days": "last_30"}, f"WITH d AS ({DAYS}), x AS ({MONTHS}) SELECT m AS month, (SELECT round(sum(d.v), 2) FROM d WHERE d.d > last_day(m) - 30 AND d.d <= last_day(m)) AS last_30 FROM x")
view_query(
    "whole_periods", {"Order Month": "month"}, {"Revenue Whole Prior Year": "prior_year", "Revenue Quarter Before": "quarter_before", "Revenue Next Quarter": "next_quarter"},
    f"""WITH x AS ({MONTHS}), y AS (SELECT year(m) AS y, sum(v) AS v FROM x GROUP BY 1), q AS (SELECT date_trunc('quarter', m) AS q, sum(v) AS v FROM x GROUP BY 1)
    SELECT x.m AS month, round(y.v, 2) AS prior_year, round(a.v, 2) AS quarter_before, round(b.v, 2) AS next_quarter FROM x LEFT JOIN y ON y.y = year(x.m) - 1 LEFT JOIN q a ON a.q = date_trunc('quarter', x.m) - INTERVAL 3 MONTH LEFT JOIN q b ON b.q = date_trunc('quarter', x.m) + INTERVAL 3 MONTH""",
)
view_query(
    "day_shifts", {"Order Day": "day"}, {"Revenue Day Before": "before", "Revenue Next Day": "after", "Revenue Week Before": "week"},
    f"WITH d AS ({DAYS}) SELECT a.d AS day, round(b.v, 2) AS before, round(c.v, 2) AS after, round(w.v, 2) AS week FROM d a LEFT JOIN d b ON b.d = a.d - 1 LEFT JOIN d c ON c.d = a.d + 1 LEFT JOIN d w ON w.d = a.d - 7",
)
view_query(
    "opening_and_closing", {"Order Month": "month"}, {"Opening Revenue": "opening", "Closing Revenue": "closing"},
    f"WITH d AS ({DAYS}), x AS ({MONTHS}) SELECT x.m AS month, round(a.v, 2) AS opening, round(b.v, 2) AS closing FROM x LEFT JOIN d a ON a.d = x.m - 1 LEFT JOIN d b ON b.d = last_day(x.m)",
)
view_query(
    "suppliers_to_date", {"Order Month": "month"}, {"Suppliers YTD": "suppliers"},
    f"WITH s AS (SELECT DISTINCT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS m, l_suppkey AS s FROM {STAR}) SELECT x.m AS month, count(DISTINCT s.s) AS suppliers FROM (SELECT DISTINCT m FROM s) x JOIN s ON year(s.m) = year(x.m) AND s.m <= x.m GROUP BY 1",
)
view_query(
    "rank_in_a_measure", {"Brand": "brand"}, {"Brand Position": "position", "Total Revenue": "revenue"},
    f"SELECT * FROM (SELECT brand, CAST(dense_rank() OVER (ORDER BY v DESC) AS INTEGER) AS position, round(v, 2) AS revenue FROM (SELECT p_brand AS brand, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1)) WHERE brand IN ('Brand#11', 'Brand#23', 'Brand#5')", where='part[p_brand] IN {"Brand#11", "Brand#23", "Brand#5"}',
)
view_query(
    "top_customers_by_region", {"Region": "region"}, {"Top Customers Revenue": "revenue"},
    f"SELECT region, round(sum(v), 2) AS revenue FROM (SELECT region, v, rank() OVER (PARTITION BY region ORDER BY v DESC) AS k FROM (SELECT r.r_name AS region, c.c_custkey, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1",
)
view_query(
    "values_on_last_days", {"Region": "region"}, {"Last Order Value": "last_order", "Revenue on Last Return": "last_return"},
    f"""WITH x AS (SELECT r.r_name AS g, CAST(o.o_orderdate AS DATE) AS d, sum(l_extendedprice) AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM {STAR} GROUP BY 1, 2)
    SELECT g AS region, round(arg_max(v, d), 2) AS last_order, round(arg_max(v, d) FILTER (WHERE n > 0), 2) AS last_return FROM x GROUP BY 1""",
)
view_query("pairs_of_values", {"Segment": "segment"}, {"Flag Pairs": "pairs"}, f"SELECT c.c_mktsegment AS segment, count(DISTINCT (l_returnflag, l_linestatus)) AS pairs FROM {STAR} GROUP BY 1")
view_query("lookup_value", {"l_returnflag": "flag"}, {"Asian Revenue": "revenue"}, f"SELECT l_returnflag AS flag, round(sum(l_extendedprice) FILTER (WHERE r.r_name = 'ASIA'), 2) AS revenue FROM {STAR} GROUP BY 1")
view_query(
    "last_value_filtered", {"event_type": "kind"}, {"Last Value": "last_value", "Last Purchase Value": "last_purchase"},
    "WITH x AS (SELECT event_type AS kind, ts, max(value) AS v FROM events GROUP BY 1, 2) SELECT kind, arg_max(v, ts) FILTER (WHERE v IS NOT NULL) AS last_value, arg_max(v, ts) FILTER (WHERE v IS NOT NULL AND kind = 'purchase') AS last_purchase FROM x GROUP BY 1", fact="events",
)
view_query("joined_in_order", {"n_name": "nation"}, {"Names by Balance": "names"}, "SELECT n_name AS nation, coalesce(string_agg(s_name, ';' ORDER BY s_acctbal DESC, s_name DESC) FILTER (WHERE s_acctbal > 0), '') AS names FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", fact="supplier")


def table_query(name: str, expression: str, names: dict[str, str], sql: str) -> None:
    """A table expression of the measure language."""
    QUERIES[name], SQL[name] = lambda spark, sf_dir: tidy(samples.view(spark, sf_dir).table(expression), names), sql


table_query("summarized_columns", 'SUMMARIZECOLUMNS(region[r_name], customer[c_mktsegment], "Revenue", [Total Revenue], "Lines", [Lines])', {"r_name": "region", "c_mktsegment": "segment", "revenue": "revenue", "lines": "n_lines"}, f"SELECT r.r_name AS region, c.c_mktsegment AS segment, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n_lines FROM {STAR} GROUP BY 1, 2")
table_query("added_columns", 'ADDCOLUMNS(SUMMARIZE(lineitem, nation[n_name]), "Revenue", [Total Revenue], "Per Line", DIVIDE([Revenue], [Lines]))', {"n_name": "nation", "revenue": "revenue", "per line": "per_line"}, f"SELECT n.n_name AS nation, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) / count(*), 2) AS per_line FROM {STAR} GROUP BY 1")
table_query("filtered_table", 'FILTER(ADDCOLUMNS(VALUES(nation[n_name]), "Orders", DISTINCTCOUNTNOBLANK(lineitem[l_orderkey])), [Orders] > 60)', {"n_name": "nation", "orders": "orders"}, f"SELECT n.n_name AS nation, count(DISTINCT l_orderkey) AS orders FROM {STAR} GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 60")
table_query("first_of_a_table", 'TOPN(5, ADDCOLUMNS(VALUES(nation[n_name]), "Revenue", [Total Revenue]), [Total Revenue])', {"n_name": "nation", "revenue": "revenue"}, f"SELECT nation, round(v, 2) AS revenue FROM (SELECT nation, v, rank() OVER (ORDER BY v DESC) AS k FROM (SELECT n.n_name AS nation, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1)) WHERE k <= 5")
table_query("crossed_values", 'ADDCOLUMNS(CROSSJOIN(VALUES(lineitem[l_returnflag]), VALUES(customer[c_mktsegment])), "Lines", [Lines])', {"l_returnflag": "flag", "c_mktsegment": "segment", "lines": "n_lines"}, f"SELECT l_returnflag AS flag, c.c_mktsegment AS segment, count(*) AS n_lines FROM {STAR} GROUP BY 1, 2")


@query(f"SELECT p_brand AS brand, round(v, 2) AS revenue, CAST(dense_rank() OVER (ORDER BY v DESC) AS INTEGER) AS rank FROM (SELECT p_brand, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1)")
def brand_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(samples.view(spark, sf_dir).ranked(["Brand"], "Total Revenue"), {"Brand": "brand", "Total Revenue": "revenue", "rank": "rank"})


@query(f"SELECT c_name AS customer, round(v, 2) AS revenue FROM (SELECT c_name, v, rank() OVER (ORDER BY v DESC) AS k FROM (SELECT c_name, sum(l_extendedprice) AS v FROM {STAR} GROUP BY 1)) WHERE k <= 10")
def top_customers_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(samples.view(spark, sf_dir).top(["c_name"], "Total Revenue", 10), {"c_name": "customer", "Total Revenue": "revenue"})


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_orderstatus, c_name, p_brand FROM {STAR}")
def star_wide_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.view(spark, sf_dir).wide(["orders", "customer", "part"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "o_orderstatus", "c_name", "p_brand")


@query(f"""SELECT r.r_name AS region, n.n_name AS nation, round(sum(l_extendedprice), 2) AS revenue FROM {STAR} GROUP BY ROLLUP (r.r_name, n.n_name)""")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a hierarchy with their subtotals."""
    rows = samples.view(spark, sf_dir).wide(["nation", "region"]).rollup("r_name", "n_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "revenue")


@query("""SELECT CAST(d AS DATE) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, strftime(d, '%Y-%m') AS year_month,
    d BETWEEN DATE '2024-01-01' AND DATE '2024-03-15' AS is_current_ytd, d BETWEEN DATE '2024-03-01' AND DATE '2024-03-15' AS is_current_mtd, CAST(d - INTERVAL 12 MONTH AS DATE) AS date_key_ly FROM generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY) t(d)""")
def calendar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeintel.calendar(spark, today=F.lit("2024-03-15").cast("date"))
    return rows.select("date_key", "year", "quarter", "month", "year_month", "is_current_ytd", "is_current_mtd", "date_key_ly")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeintel.last_per_entity(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT CAST(p AS DATE) AS period, round(sum(value), 2) AS balance, count(*) AS entities FROM (SELECT user_id, date_trunc('month', ts) AS p, value, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1 GROUP BY p")
def closing_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeintel.balance(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "value", tie="event_id")
    return rows.select("period", F.round("balance", 2).alias("balance"), "entities")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def carried_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value"))).withColumn("at", F.struct("ts", "event_id"))
    return timeintel.carried(rows, "user_id", "at", "bought").select("event_id", F.col("carried").alias("last_purchase"))


@query(f"WITH x AS ({MONTHS}) SELECT m AS month, round(sum(v) OVER (ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 2) AS trailing FROM x")
def declared_trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trailing window leaves its anchor out."""
    rows = samples.view(spark, sf_dir).query(["Order Month"], ["Total Revenue"]).toDF("month", "v")
    return timeintel.window_measure(rows, "month", "v", trailing=3, name="trailing").select("month", F.round("trailing", 2).alias("trailing"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def fan_out_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.fan_out(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_duplicated FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def key_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.cardinality(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0")
    return validation.orphans(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", some, "c_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT 'o_orderstatus' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus IS NULL) AS n_null FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) FILTER (WHERE o_custkey IS NULL) FROM orders""")
def null_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.null_density(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus", "o_custkey").select("column", "n_rows", "n_null")


@query("SELECT min(CAST(o_orderdate AS DATE)) AS first_fact, max(CAST(o_orderdate AS DATE)) AS last_fact, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') AS n_outside FROM orders")
def date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = samples.calendar(spark, "1996-01-01", "1999-12-31")
    return validation.date_coverage(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", days, "Date").select("first_fact", "last_fact", "n_outside")


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.5 ELSE o_totalprice END) AS v FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_ours, b.k IS NOT NULL AS in_theirs, coalesce(a.k IS NOT NULL AND b.k IS NOT NULL AND (abs(a.v - b.v) <= 0.01 OR abs(a.v - b.v) <= 1e-4 * greatest(abs(a.v), abs(b.v))), false) AS matches FROM a FULL JOIN b ON a.k = b.k""")
def parity_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "k")
    ours = orders.groupBy("k").agg(F.sum("o_totalprice").alias("v"))
    theirs = orders.where("o_orderpriority != '1-URGENT'").groupBy("k").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice"))).alias("v"))
    return validation.parity(ours, theirs, ["k"], "v").select("k", "in_ours", "in_theirs", "matches")


@query("""WITH t AS (SELECT o_orderstatus AS name FROM orders), u AS (SELECT l_linestatus AS name FROM lineitem LIMIT 0), a AS (SELECT o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderpriority AS name FROM orders WHERE o_totalprice > 200000)
    SELECT name, change, count(*) AS n FROM (SELECT name, 'dropped' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT name, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY 1, 2""")
def coverage_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderpriority", "name")
    found = validation.coverage(orders.where("o_orderstatus = 'F'"), orders.where("o_totalprice > 200000"))
    return found.groupBy("name", "change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS name, count(*) AS n FROM (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_orderpriority FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderpriority", "name")
    return orders.where("o_orderstatus = 'F'").select("name").intersectAll(orders.where("o_totalprice > 200000").select("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT b.l_partkey FROM lineitem b JOIN supplier s ON b.l_suppkey = s.s_suppkey WHERE s.s_acctbal > 5000)")
def many_to_many_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rich = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 5000")
    return validation.through_bridge(lines, "l_partkey", lines.select(F.col("l_partkey").alias("near"), F.col("l_suppkey").alias("far")), "near", "far", rich, "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def bidirectional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"))
    return validation.filtered_dimension(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", late, "o_custkey").select("c_custkey", "c_name")


def scalar_query(name: str, fact: str, keys: list[str], expressions: dict[str, str], sql: str) -> None:
    """Row expressions of the measure language over a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = samples.view(spark, sf_dir, fact)
        used: set[str] = set()
        columns = [v.row(parse(e), used).alias(k) for k, e in expressions.items()]
        return v.frame(used).select(*[F.col(qualified(fact, k)).alias(k) for k in keys], *columns)

    QUERIES[name], SQL[name] = run, sql


scalar_query(
    "scalar_text", "orders", ["o_orderkey"],
    {
        "a": "LEFT(orders[o_orderpriority], 3)", "b": "RIGHT(orders[o_orderpriority], 2)", "c": "MID(orders[o_orderpriority], 2, 3)", "d": "LEN(orders[o_orderpriority])", "e": "UPPER(orders[o_orderpriority]) & \"-\" & orders[o_orderstatus]",
        "f": 'SUBSTITUTE(orders[o_orderpriority], "-", "+")', "g": 'SEARCH("u", orders[o_orderpriority], 1, -1)', "h": 'REPLACE(orders[o_orderpriority], 1, 1, "#")', "i": 'COMBINEVALUES("|", orders[o_orderstatus], orders[o_orderpriority])', "j": 'TRIM("  a   b ")', "k": "REPT(orders[o_orderstatus], 2)", "l": 'PATHITEM("x|y|z", 2)',
    },
    """SELECT o_orderkey, left(o_orderpriority, 3) AS a, right(o_orderpriority, 2) AS b, substr(o_orderpriority, 2, 3) AS c, CAST(length(o_orderpriority) AS INTEGER) AS d, upper(o_orderpriority) || '-' || o_orderstatus AS e, replace(o_orderpriority, '-', '+') AS f,
    CAST(CASE WHEN strpos(lower(o_orderpriority), 'u') = 0 THEN -1 ELSE strpos(lower(o_orderpriority), 'u') END AS INTEGER) AS g, '#' || substr(o_orderpriority, 2) AS h, o_orderstatus || '|' || o_orderpriority AS i, 'a b' AS j, repeat(o_orderstatus, 2) AS k, 'y' AS l FROM orders""",
)
scalar_query(
    "scalar_math", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"],
    {
        "a": "ROUND(lineitem[l_extendedprice] / 7, 2)", "b": "INT(0 - lineitem[l_quantity] / 3)", "c": "ROUNDUP(lineitem[l_extendedprice], -2)", "d": "ROUNDDOWN(0 - lineitem[l_extendedprice], -2)", "e": "MOD(0 - lineitem[l_linenumber], 3)", "f": "POWER(lineitem[l_linenumber], 2)",
        "g": "DIVIDE(lineitem[l_quantity], lineitem[l_linenumber] - 1, -1)", "h": "MIN(lineitem[l_linenumber], 3)", "i": "ROUND(LOG(lineitem[l_quantity], 2), 6)", "j": "ABS(lineitem[l_linenumber] - 4)", "k": "ROUND(SQRT(lineitem[l_quantity]) + EXP(0) + LN(1), 6)",
    },
    """SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice / 7, 2) AS a, CAST(floor(-l_quantity / 3) AS BIGINT) AS b, ceil(l_extendedprice * 0.01) / 0.01 AS c, -floor(l_extendedprice * 0.01) / 0.01 AS d, CAST(((-l_linenumber) % 3 + 3) % 3 AS BIGINT) AS e, CAST(l_linenumber * l_linenumber AS DOUBLE) AS f,
    coalesce(l_quantity / nullif(l_linenumber - 1, 0), -1) AS g, least(l_linenumber, 3) AS h, round(ln(l_quantity) / ln(2), 6) AS i, abs(l_linenumber - 4) AS j, round(sqrt(l_quantity) + 1, 6) AS k FROM lineitem""",
)
scalar_query(
    "scalar_dates", "orders", ["o_orderkey"],
    {
        "a": "YEAR(orders[order_date])", "b": "MONTH(orders[order_date])", "c": "DAY(orders[order_date])", "d": "EOMONTH(orders[order_date], 1)", "e": "WEEKDAY(orders[order_date])", "f": "WEEKDAY(orders[order_date], 2)", "g": "DATEDIFF(orders[order_date], DATE(2001, 8, 1), MONTH)", "h": "DATEDIFF(orders[order_date], DATE(2001, 8, 1), DAY)", "i": "EDATE(orders[order_date], -12)",
        "j": 'FORMAT(orders[order_date], "yyyy-MM")', "k": "WEEKNUM(orders[order_date], 21)", "l": "ENDOFQUARTER(orders[order_date])",
    },
    """SELECT o_orderkey, CAST(year(d) AS INTEGER) AS a, CAST(month(d) AS INTEGER) AS b, CAST(day(d) AS INTEGER) AS c, CAST(last_day(d + INTERVAL 1 MONTH) AS DATE) AS d, CAST(dayofweek(d) + 1 AS INTEGER) AS e, CAST(isodow(d) AS INTEGER) AS f, CAST(date_diff('month', d, DATE '2001-08-01') AS INTEGER) AS g, CAST(date_diff('day', d, DATE '2001-08-01') AS INTEGER) AS h,
    CAST(d - INTERVAL 12 MONTH AS DATE) AS i, strftime(d, '%Y-%m') AS j, CAST(weekofyear(d) AS INTEGER) AS k, CAST(last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH) AS DATE) AS l FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
scalar_query(
    "scalar_logic", "orders", ["o_orderkey"],
    {
        "a": 'IF(orders[o_totalprice] > 200000 && NOT orders[o_orderstatus] = "F", "x", "y")', "b": 'SWITCH(orders[o_orderstatus], "F", 1, "O", 2, 0)', "c": "ISBLANK(orders[o_orderstatus])", "d": 'IF(OR(orders[o_orderstatus] = "P", orders[o_totalprice] < 1000), TRUE(), FALSE())',
        "e": 'COALESCE(BLANK(), orders[o_orderstatus])', "f": 'IF(orders[o_orderpriority] IN {"1-URGENT", "2-HIGH"}, 1, 0)', "g": 'EXACT(orders[o_orderstatus], "F")',
    },
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND NOT o_orderstatus = 'F' THEN 'x' ELSE 'y' END AS a, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS b, o_orderstatus IS NULL AS c, (o_orderstatus = 'P' OR o_totalprice < 1000) AS d, o_orderstatus AS e,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS f, o_orderstatus = 'F' AS g FROM orders""",
)


# --- the sample model's metadata


def finance():
    from starweave.model import Column, Measure, Relationship, SemanticModel, Table

    sales = Table("FactSales", None, tuple(Column(c, k) for c, k in (("CustomerKey", "int64"), ("OrderDate", "dateTime"), ("Revenue", "decimal"), ("Cost", "decimal"))), (
        Measure("Total Revenue", "SUM(FactSales[Revenue])"), Measure("Total Cost", "SUM(FactSales[Cost])"), Measure("Margin", "[Total Revenue] - [Total Cost]"), Measure("Margin Share", "DIVIDE([Margin], [Total Revenue])"),
        Measure("Revenue YTD", "TOTALYTD([Total Revenue], DimDate[Date])"), Measure("Open", "[Nothing] + FactSales[Missing]"), Measure("Loop A", "[Loop B] + 1"), Measure("Loop B", "[Loop A] * 2"), Measure("Rows Above", 'CALCULATE([Total Revenue], FactSales[Cost] > 5)'),
    ), source_hint="Teradata: td.example.com.EDW.V_SALES")
    customer = Table("DimCustomer", None, (Column("CustomerKey", "int64"), Column("Region", "string")), source_hint="Teradata: td.EDW.CUSTOMER")
    date = Table("DimDate", None, (Column("Date", "dateTime"), Column("Year", "int64")))
    return SemanticModel("finance", (sales, customer, date), (Relationship("FactSales", "CustomerKey", "DimCustomer", "CustomerKey"), Relationship("FactSales", "OrderDate", "DimDate", "Date")))


@query("""SELECT * FROM (VALUES ('Total Revenue', 100, 'AUTO', 'A', 0, false), ('Total Cost', 100, 'AUTO', 'A', 0, false), ('Margin', 100, 'AUTO', 'B', 1, false), ('Margin Share', 100, 'AUTO', 'B', 2, false), ('Revenue YTD', 35, 'MANUAL_PORT', 'C', 1, false),
    ('Open', 100, 'AUTO', 'A', 0, false), ('Loop A', 20, 'MANUAL_PORT', 'F', 1, true), ('Loop B', 20, 'MANUAL_PORT', 'F', 1, true), ('Rows Above', 85, 'AUTO_SPOT_CHECK', 'D', 1, false)) t(name, score, band, category, depth, cyclic)""")
def measure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify(spark, finance()).select("name", "score", "band", "category", "depth", "cyclic")


@query("SELECT * FROM (VALUES ('LOW', CAST(6 AS BIGINT)), ('HIGH', CAST(3 AS BIGINT))) t(bucket, n)")
def complexity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(scoring.classify(spark, finance()), "bucket")


@query("""WITH RECURSIVE e(src, dst) AS (VALUES ('Margin', 'Total Revenue'), ('Margin', 'Total Cost'), ('Margin Share', 'Margin'), ('Margin Share', 'Total Revenue'), ('Revenue YTD', 'Total Revenue'), ('Rows Above', 'Total Revenue'), ('Loop A', 'Loop B'), ('Loop B', 'Loop A')),
    r(id, d) AS (SELECT 'Margin Share', 0 UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id) SELECT id, CAST(min(d) AS INTEGER) AS distance FROM r GROUP BY id""")
def lineage_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = scoring.resolved(spark, finance())[0].where("kind = 'MEASURE'").select(F.col("measure").alias("src"), F.col("target").alias("dst"))
    return catalog.reachable(edges, "Margin Share")


@query("SELECT * FROM (VALUES ('Open', '[Nothing]', 'unknown measure or column'), ('Open', 'FactSales[Missing]', 'unknown column')) t(measure, reference, reason)")
def reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.gap_inventory(spark, finance())
    return rows.select(F.regexp_replace("object_ref", "^Measure:", "").alias("measure"), "reference", "reason")


@query("SELECT * FROM (VALUES ('DimCustomer', 'td', 'EDW', 'CUSTOMER', 'BASE_TABLE'), ('FactSales', 'td.example.com', 'EDW', 'V_SALES', 'VIEW')) t(\"table\", database, \"schema\", object, object_type)")
def upstream_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.model import frames

    return catalog.referenced_objects(frames(spark, finance())).drop("model")


@query("SELECT * FROM (VALUES ('MODEL', CAST(1 AS BIGINT)), ('TABLE', 3), ('COLUMN', 8), ('MEASURE', 9), ('RELATIONSHIP', 2), ('SOURCE', 2)) t(kind, n)")
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(catalog.lineage(spark, finance())[0], "kind")


@query("SELECT * FROM (VALUES ('CONTAINS_TABLE', CAST(3 AS BIGINT)), ('HAS_COLUMN', 8), ('HAS_MEASURE', 9), ('RELATES_FROM', 2), ('RELATES_TO', 2), ('SOURCED_FROM', 2), ('USES_MEASURE', 8), ('USES_COLUMN', 4)) t(kind, n)")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(catalog.lineage(spark, finance())[1], "kind")


@query("SELECT * FROM (VALUES ('FactSales', CAST(9 AS BIGINT))) t(fact, n)")
def fact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(scoring.fact_groups(spark, finance())[0], "fact")


@query("SELECT * FROM (VALUES ('DimCustomer'), ('DimDate')) t(dimension)")
def dimension_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fact_groups(spark, finance())[1].select("dimension")


@query("SELECT * FROM (VALUES ('auto', CAST(5 AS BIGINT)), ('engine', 1), ('unsupported', 3)) t(status, n)")
def translation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    def no_rows(_):
        raise AssertionError("translation reads no data")

    return catalog.histogram(translations(spark, MetricView(finance(), "FactSales", no_rows)), "status")


# --- checks and reviews over rows of the tables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT 'price' AS "column", 'varchar_numeric' AS issue UNION ALL SELECT 'day', 'string_date' WHERE (SELECT avg(CASE WHEN regexp_matches(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 1 ELSE 0 END) FROM orders) >= 0.8""")
def text_columns_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    rows = orders.select(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"), F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderpriority")
    return validation.text_flags(rows).select("column", "issue")


@query("SELECT CASE WHEN regexp_matches(v, '^[0-9]+$') THEN 'number' WHEN regexp_matches(v, '^[0-9]{4}-') THEN 'date' ELSE 'text' END AS kind, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN CAST(o_orderkey AS VARCHAR) WHEN 'O' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE o_orderpriority END AS v FROM orders) GROUP BY 1")
def kinds_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).when(F.col("o_orderstatus") == "O", F.col("o_orderdate").cast("date").cast("string")).otherwise(F.col("o_orderpriority"))
    return validation.type_mix(read(spark, sf_dir, "orders").select(v.alias("v")), "v")


@query("""WITH c AS (SELECT CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE 'dim_' || lower(n_name) || '_v2' END AS leaf FROM nation WHERE n_regionkey <> 0),
    p AS (SELECT n_name AS name, leaf, row_number() OVER (PARTITION BY n_name ORDER BY lower(n_name) <> leaf, abs(length(n_name) - length(leaf)), leaf) AS k FROM nation JOIN c ON contains(lower(n_name), leaf) OR contains(leaf, lower(n_name)))
    SELECT n_name AS name, 'lake.dim.' || leaf AS physical, CASE WHEN leaf IS NULL THEN 'none' WHEN leaf = lower(n_name) THEN 'exact' ELSE 'contains' END AS how FROM nation LEFT JOIN p ON p.name = n_name AND k = 1""")
def tables_matched_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    leaf = F.when(F.col("n_regionkey") == 1, F.lower("n_name")).otherwise(F.concat(F.lit("dim_"), F.lower("n_name"), F.lit("_v2")))
    return validation.matched_tables(nation.select(F.col("n_name").alias("name")), nation.where("n_regionkey != 0").select(F.concat(F.lit("lake.dim."), leaf).alias("physical")))


@query("""SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'dropped' WHEN a.name IS NULL THEN 'extra' WHEN a.e = b.e THEN 'same' ELSE 'altered' END AS state
    FROM (SELECT CAST(p_partkey AS VARCHAR) AS name, 'SUM( ' || p_name || ' )' AS e FROM part WHERE p_size > 5) a FULL JOIN (SELECT CAST(p_partkey AS VARCHAR) AS name, 'SUM( ' || CASE WHEN p_size > 40 THEN p_brand ELSE p_name END || ' )' AS e FROM part WHERE p_size < 45) b ON a.name = b.name""")
def expressions_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("name", F.col("p_partkey").cast("string"))
    truth = part.where("p_size > 5").select("name", F.concat(F.lit("SUM(  "), "p_name", F.lit(" )")).alias("expression"))
    found = part.where("p_size < 45").select("name", F.concat(F.lit("SUM( "), F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.col("p_name")), F.lit("  )")).alias("expression"))
    return validation.fidelity(truth, found)


@query("""WITH t AS (SELECT DISTINCT lower(p_brand) AS a, lower(p_type) AS b FROM part), f AS (SELECT DISTINCT lower(p_brand) AS a, lower(p_type) AS b FROM part WHERE p_size > 25 UNION SELECT 'extra', lower(p_type) FROM part)
    SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM f)) AS n_found, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM t)) AS n_extra""")
def edges_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), "p_size")
    found = edges.where("p_size > 25").select(F.upper("src").alias("src"), "dst").unionByName(edges.select(F.lit("extra").alias("src"), "dst"))
    return validation.edge_recall(edges.select("src", "dst"), found).select("n_truth", "n_found", "n_extra")


@query("""SELECT c_name AS from_table, CASE WHEN c_acctbal < 0 AND c_nationkey < 5 THEN 'cardinality,is_active' WHEN c_acctbal < 0 THEN 'cardinality' ELSE 'is_active' END AS differs FROM customer WHERE c_acctbal < 0 OR c_nationkey < 5""")
def properties_that_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_name").alias("from_table"), F.lit("k").alias("from_column"), F.lit("t").alias("to_table"), F.lit("k").alias("to_column"), F.lit("MANY_TO_ONE").alias("cardinality"), F.lit("SINGLE").alias("cross_filter"), F.lit(True).alias("is_active"), "c_acctbal", "c_nationkey")
    other = rows.withColumns({"cardinality": F.when(F.col("c_acctbal") < 0, "MANY_TO_MANY").otherwise(F.col("cardinality")), "is_active": F.col("c_nationkey") >= 5})
    return validation.property_agreement(rows, other).select("from_table", F.array_join("differs", ",").alias("differs"))


@query("SELECT substr(sha256('salt' || c_name), 1, 12) AS name, c_mktsegment AS segment FROM customer")
def names_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.redacted(read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "salt", "name")


@query("SELECT p_name AS name, p_partkey AS k, CASE WHEN p_size > 40 THEN 'dropped' WHEN p_size > 30 THEN 'reviewed' ELSE 'auto' END AS status, CASE WHEN p_size BETWEEN 31 AND 40 THEN p_type ELSE p_brand END AS sql FROM part")
def edits_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("name", F.col("p_partkey").cast("string"))
    edits = part.where("p_size > 30").select("name", F.when(F.col("p_size") <= 40, F.col("p_type")).alias("new_sql"), (F.col("p_size") > 40).alias("drop"))
    done = validation.change_request(part.select("name", F.col("p_brand").alias("sql"), F.lit("auto").alias("status")), edits)
    return done.join(part.select("name", "p_name", "p_partkey"), "name").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"), "status", "sql")


@query("""WITH f AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS s FROM orders WHERE o_totalprice > 450000)
    SELECT CAST(greatest(0, 100 - coalesce(sum(CASE s WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 4 ELSE 1 END), 0)) AS INTEGER) AS score, count(*) AS n FROM f""")
def findings_weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "MEDIUM").otherwise("LOW")
    found = read(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.lit("A1").alias("finding"), severity.alias("severity"), F.col("o_orderkey").cast("string").alias("object"))
    return validation.review(found).select("score", "n")


@query("""WITH v AS (SELECT o_custkey AS k, min(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS ok FROM orders GROUP BY 1), s AS (SELECT c_custkey AS k, CAST(abs(CAST(floor(c_acctbal) AS BIGINT)) % 101 AS INTEGER) AS score FROM customer)
    SELECT s.k AS k, CAST(CASE WHEN ok = 1 THEN greatest(score, CASE WHEN score >= 40 THEN 95 ELSE 80 END) WHEN ok = 0 THEN least(score, 40) ELSE score END AS INTEGER) AS score FROM s LEFT JOIN v ON s.k = v.k""")
def scores_after_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.pmod(F.abs(F.floor("c_acctbal")), F.lit(101)).cast("int").alias("score"))
    seen = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderstatus") != "F").alias("matches"))
    return validation.rescored(scores, seen).select(F.col("name").alias("k"), F.col("score").cast("int").alias("score"))


@query("SELECT c_mktsegment AS counter, count(*) AS expected, count(*) FILTER (WHERE c_acctbal > 0) AS found, round(count(*) FILTER (WHERE c_acctbal > 0) / count(*), 6) AS ratio FROM customer GROUP BY 1")
def counters_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("counter"), F.lit(1).cast("long").alias("expected"), (F.col("c_acctbal") > 0).cast("long").alias("found"))
    return validation.scorecard(rows).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT s_name AS name, CASE s_nationkey % 3 WHEN 0 THEN 'SQL Server / Azure SQL' WHEN 1 THEN 'CSV,Web' ELSE 'Other / none detected' END AS kinds FROM supplier""")
def kinds_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.sources.models import source_kinds

    kind = F.col("s_nationkey") % 3
    text = F.concat(F.when(kind == 0, 'Sql.Database("').when(kind == 1, 'Csv.Document(Web.Contents("').otherwise('let x = ("'), F.col("s_name"), F.lit('"))'))
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.array_join(source_kinds(text), ",").alias("kinds"))


@query("SELECT s_name AS name, 'host.example' AS database, 'DB' AS schema, 'V_' || s_suppkey AS object, 'VIEW' AS object_type FROM supplier")
def hints_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starweave.sources.models import hint_parts, source_hints

    query_text = F.concat(F.lit('Teradata.Database(Host){[Schema="DB"]}[Data]{[Name="V_'), F.col("s_suppkey").cast("string"), F.lit('"]}'))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("table"), query_text.alias("query"))
    return source_hints(rows, spark.createDataFrame([("Host", "host.example")], "name string, value string")).select(F.col("table").alias("name"), hint_parts(F.col("hint")).alias("h")).select("name", "h.*")


@query(f"WITH x AS ({MONTHS}) SELECT a.m AS month, round(a.v / sum(a.v) OVER (), 8) AS share, round(b.v, 2) AS before, round(sum(a.v) OVER (PARTITION BY year(a.m) ORDER BY a.m), 2) AS running FROM x a LEFT JOIN x b ON b.m = CAST(a.m - INTERVAL 1 MONTH AS DATE)")
def months_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, shifts and running totals of a frame."""
    rows = samples.view(spark, sf_dir).query(["Order Month"], ["Total Revenue"]).toDF("month", "v")
    rows = timeintel.running(timeintel.shifted(timeintel.share_of(rows, "v"), "month", ["v"], -1), "month", "v")
    return rows.select("month", F.round("share", 8).alias("share"), F.round("v_prior", 2).alias("before"), F.round("running", 2).alias("running"))


#: Result columns that hold dates; they leave as text, so that any engine's date type compares equal.
DATES = {
    "revenue_prior_year": ["month"], "revenue_prior_and_next_month": ["month"], "revenue_to_date": ["month"], "revenue_yoy": ["month"], "revenue_rolling_3m": ["month"], "ratio_to_date": ["quarter"],
    "concatenated_values": ["first_order", "last_order"], "calendar_table": ["date_key", "date_key_ly"], "closing_balance": ["period"], "declared_trailing_window": ["month"],
    "prior_year_under_base_filter": ["month"], "prior_year_under_date_filter": ["month"], "year_to_date_under_date_filter": ["month"], "rolling_30_days": ["month"], "whole_periods": ["month"], "day_shifts": ["day"],
    "months_compared": ["month"], "opening_and_closing": ["month"], "suppliers_to_date": ["month"],
    "cumulative_by_filter": ["month"], "cumulative_under_date_filter": ["month"], "trailing_days_by_filter": ["day"], "suppliers_by_day_to_date": ["day"], "suppliers_by_customer_to_date": ["month"], "customers_to_date": ["month"], "four_contexts": ["month"],
    "date_coverage": ["first_fact", "last_fact"], "scalar_dates": ["d", "i", "l"],
}


def _as_text(f: Query, names: list[str]) -> Query:
    return lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in names})


# --- models whose measures are made from rows: one model for each brand, one measure for each part

PARTS = """p AS (SELECT p_brand AS model, p_partkey AS k, CAST(p_size AS INTEGER) AS size, CAST(p_size AS INTEGER) % 8 AS kind, CAST(floor(p_partkey / 75) AS BIGINT) AS grp FROM part),
q AS (SELECT *, lag(k) OVER (PARTITION BY model, grp ORDER BY k) AS before, lead(k) OVER (PARTITION BY model, grp ORDER BY k) AS after FROM p),
dep AS (SELECT *, CASE WHEN kind = 7 THEN coalesce(after, before) WHEN kind > 1 THEN before END AS other FROM q)"""
REACH = f"""{PARTS}, reach AS (SELECT k AS src, other AS dst FROM dep WHERE other IS NOT NULL UNION SELECT reach.src, dep.other FROM reach JOIN dep ON dep.k = reach.dst WHERE dep.other IS NOT NULL),
own AS (SELECT *, CASE kind WHEN 1 THEN 85 WHEN 3 THEN 76 WHEN 4 THEN 35 WHEN 5 THEN 90 WHEN 6 THEN 35 WHEN 7 THEN 70 ELSE 100 END AS base, k IN (SELECT src FROM reach WHERE src = dst) AS cyclic FROM dep),
own2 AS (SELECT *, least(base, CASE WHEN model LIKE '%5' THEN 45 ELSE 100 END, CASE WHEN cyclic THEN 20 ELSE 100 END) AS own FROM own),
below AS (SELECT reach.src, min(own2.own) AS least, count(CASE WHEN reach.dst <> reach.src THEN 1 END) AS depth FROM reach JOIN own2 ON own2.k = reach.dst GROUP BY 1),
score AS (SELECT o.*, least(o.own, coalesce(b.least, 100)) AS score, coalesce(b.depth, 0) AS depth FROM own2 o LEFT JOIN below b ON b.src = o.k)"""
BAND = "CASE WHEN score >= 90 THEN 'AUTO' WHEN score >= 70 THEN 'AUTO_SPOT_CHECK' WHEN score >= 40 THEN 'NEEDS_REVIEW' WHEN score >= 11 THEN 'MANUAL_PORT' ELSE 'UNSUPPORTED' END"


def estate_of_parts(spark: SparkSession, sf_dir: str) -> estate.Estate:
    parts = read(spark, sf_dir, "part").selectExpr("p_brand AS model", "p_partkey AS k", "cast(p_size AS int) AS size", "cast(p_size AS int) % 8 AS kind", "floor(p_partkey / 75) AS grp")
    near = Window.partitionBy("model", "grp").orderBy("k")  # 75 rows at most
    rows = parts.withColumns({"before": F.lag("k").over(near), "after": F.lead("k").over(near)})
    other = F.when(F.col("kind") == 7, F.coalesce("after", "before")).when(F.col("kind") > 1, F.col("before"))
    p = F.coalesce(F.concat(F.lit("[M"), other.cast("string"), F.lit("]")), F.lit("SUM(Sales[Amount])"))
    forms = [
        F.lit("SUM([Amount])"), F.concat(F.lit("CALCULATE(SUM(sales[Amount]), "), F.when(F.col("size") > 40, "Gone").otherwise("Sales"), F.lit("[Size] > "), F.col("size").cast("string"), F.lit(")")),
        F.concat(F.lit("DIVIDE("), p, F.lit(", COUNTROWS(Sales))")), F.concat(F.lit("IF(ISBLANK("), p, F.lit("), 0, "), p, F.lit(")")), F.concat(F.lit("TOTALYTD("), p, F.lit(", 'Calendar'[Date])")),
        F.concat(F.lit("VAR x = "), p, F.lit(" RETURN x * MAX([Key])")), F.concat(F.lit("RANKX(ALL(Sales[Size]), "), p, F.lit(")")), F.concat(F.lit("FOO("), p, F.lit(") + Sales[Missing]")),
    ]
    measures = rows.select("model", F.lit("Sales").alias("table"), F.concat(F.lit("M"), F.col("k").cast("string")).alias("name"), F.get(F.array(*forms), F.col("kind")).alias("expression"))
    models = rows.select("model").distinct()
    have = {"Sales": ("Amount", "Size"), "Calendar": ("Date", "Key"), "Product": ("Key",)}
    columns = models.select("model", F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("name")) for t, cs in have.items() for c in cs])).alias("c")).select("model", "c.*")
    tables = columns.select("model", F.col("table").alias("name")).distinct()
    both = F.when(F.col("model").endswith("5"), "BOTH").otherwise("SINGLE").alias("cross_filter")
    relationships = models.select("model", F.lit("Sales").alias("from_table"), F.lit("Calendar").alias("to_table"), F.lit("MANY_TO_ONE").alias("cardinality"), both, F.lit(True).alias("is_active"))
    return estate.Estate(tables, columns, measures, relationships)


@query(f"""WITH RECURSIVE {REACH} SELECT model, 'M' || k AS name, CAST(score AS INTEGER) AS score, {BAND} AS band, CAST(depth AS BIGINT) AS depth, cyclic,
    CASE WHEN cyclic THEN 'F' WHEN kind = 4 THEN 'C' WHEN kind = 1 THEN 'D' WHEN other IS NOT NULL OR kind = 3 THEN 'B' ELSE 'A' END AS category FROM score""")
def estate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.classify(estate_of_parts(spark, sf_dir)).select("model", "name", F.col("score").cast("int"), "band", F.col("depth").cast("long"), "cyclic", "category")


@query(f"WITH RECURSIVE {REACH}, b AS (SELECT model, {BAND} AS band FROM score) SELECT model, CASE WHEN band IN ('AUTO', 'AUTO_SPOT_CHECK') THEN 'LOW' WHEN band = 'NEEDS_REVIEW' THEN 'MEDIUM' ELSE 'HIGH' END AS bucket, count(*) AS n FROM b GROUP BY 1, 2")
def estate_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estate.classify(estate_of_parts(spark, sf_dir)).groupBy("model", "bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS} SELECT model, 'M' || k AS measure, 'Sales[Missing]' AS reference, 'unknown column' AS reason FROM dep WHERE kind = 7
    UNION ALL SELECT model, 'M' || k, 'Gone[Size]', 'unknown table' FROM dep WHERE kind = 1 AND size > 40 UNION ALL SELECT model, 'M' || k, '[Key]', 'ambiguous: columns of Calendar, Product' FROM dep WHERE kind = 5""")
def estate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estate_of_parts(spark, sf_dir)
    return estate.references_of(e, estate.traits(e.measures)).where("reason is not null").select("model", "measure", "reference", "reason")


@query(f"""WITH {PARTS}, e AS (SELECT model, 'MEASURE' AS kind, 'M' || other AS target FROM dep WHERE other IS NOT NULL UNION ALL SELECT model, 'COLUMN', 'Sales[Amount]' FROM dep WHERE other IS NULL
    UNION ALL SELECT model, 'COLUMN', 'Sales[Size]' FROM dep WHERE kind = 6 OR kind = 1 AND size <= 40 UNION ALL SELECT model, 'COLUMN', 'Calendar[Date]' FROM dep WHERE kind = 4) SELECT model, kind, target, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def estate_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estate_of_parts(spark, sf_dir)
    return estate.references_of(e, estate.traits(e.measures)).where("kind is not null").groupBy("model", "kind", "target").agg(F.count("*").alias("n"))


# Each order leads to the one before of its customer and year, and to its priority; in one segment the first leads back to the last.
ORDER_CHAINS = """o AS (SELECT o_orderkey AS k, o_orderpriority AS p, c_mktsegment AS seg, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS least
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey))"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_orderpriority")
    own = Window.partitionBy("o_custkey", "y")
    rows = rows.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    back = F.when((F.col("c_mktsegment") == "MACHINERY") & (F.max("o_orderkey").over(own) != F.col("o_orderkey")), F.max("o_orderkey").over(own))
    rows = rows.select(F.col("o_orderkey").cast("string").alias("src"), F.coalesce(F.lag("o_orderkey").over(own.orderBy("o_orderkey")), back).cast("string").alias("near"), "o_orderpriority")
    return rows.select("src", F.explode(F.array("near", "o_orderpriority")).alias("dst")).where("dst is not null")


@query(f"WITH {ORDER_CHAINS} SELECT CAST(k AS VARCHAR) AS node, CAST(CASE WHEN seg = 'MACHINERY' AND n > 1 THEN n ELSE rn END AS BIGINT) AS depth, CAST(CASE WHEN seg = 'MACHINERY' THEN n ELSE 1 END AS BIGINT) AS size FROM o UNION ALL SELECT DISTINCT p, 0, 1 FROM o WHERE p IS NOT NULL")
def lineage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.levels(order_edges(spark, sf_dir)).select("node", F.col("depth").cast("long"), F.col("size").cast("long"))


@query(f"WITH {ORDER_CHAINS} SELECT min(CAST(k AS VARCHAR)) AS component, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY CAST(k AS VARCHAR)) AS members FROM o WHERE seg = 'MACHINERY' AND n > 1 GROUP BY least")
def lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.cycles(order_edges(spark, sf_dir)).select("component", F.array_join("members", " ").alias("members"))


# --- stored aggregates

STORED = ["region[r_name]", "Date[Date]", "lineitem[l_returnflag]", "lineitem[l_suppkey]"], ["Total Revenue", "Lines", "Average Discount"]


def _stored_at(spark: SparkSession) -> str:
    return f"{scoring.shared_folder(spark)}/aggregate-{uuid.uuid4().hex}"


@query(f"""WITH x AS (SELECT r.r_name AS region, year(o.o_orderdate) AS y, l.* FROM {STAR}), a AS (SELECT region, y, sum(l_extendedprice) AS v, avg(l_discount) AS d, count(DISTINCT l_suppkey) AS s, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS back FROM x GROUP BY 1, 2)
    SELECT region, y AS year, round(v, 2) AS revenue, round(d, 6) AS discount, s AS suppliers, round(back, 2) AS returned, round(v / sum(v) OVER (PARTITION BY y), 6) AS share FROM a""")
def stored_aggregate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means, distinct counts, a filter and a share from an aggregate of days: the facts are read only to store it."""
    path, view = _stored_at(spark), samples.view(spark, sf_dir)
    stored.store(view, path, *STORED, by="Date[Date]")
    rows = samples.view(spark, sf_dir).with_stored(stored.opened(spark, path, "lineitem")).query(["Region", "Order Year"], ["Total Revenue", "Average Discount", "Suppliers", "Returned Revenue", "Share of Regions"])
    return tidy(rows, {"Region": "region", "Order Year": "year", "Total Revenue": "revenue", "Average Discount": "discount", "Suppliers": "suppliers", "Returned Revenue": "returned", "Share of Regions": "share"}, {"discount": 6, "share": 6})


@query(f"SELECT r.r_name AS region, year(o.o_orderdate) AS year, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n_lines FROM {STAR} GROUP BY 1, 2")
def stored_aggregate_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored before the orders of later years came; then the changed days alone are aggregated anew."""
    path, view = _stored_at(spark), samples.view(spark, sf_dir)
    early = MetricView(samples.model(), "lineitem", lambda t: view.source(t).where("year(o_orderdate) < 1997") if t.name == "orders" else view.source(t))
    stored.store(early, path, *STORED, by="orders[order_date]")
    days = read(spark, sf_dir, "orders").where("year(o_orderdate) >= 1997").select(F.to_date("o_orderdate").alias("day")).distinct()
    stored.refresh(view, path, *STORED, by="orders[order_date]", changed=days.union(spark.sql("SELECT CAST(NULL AS DATE)")))
    rows = samples.view(spark, sf_dir).with_stored(stored.opened(spark, path, "lineitem")).query(["Region", "Order Year"], ["Total Revenue", "Lines"])
    return tidy(rows, {"Region": "region", "Order Year": "year", "Total Revenue": "revenue", "Lines": "n_lines"})


# --- calculated columns with nested row contexts

RANKED = {
    "place": "COUNTROWS(FILTER(customer, customer[c_nationkey] = EARLIER(customer[c_nationkey]) && customer[c_acctbal] > EARLIER(customer[c_acctbal]))) + 1",
    "peers": "COUNTROWS(FILTER(customer, customer[c_nationkey] = EARLIER(customer[c_nationkey])))",
    "nearest_below": "MAXX(FILTER(customer, customer[c_mktsegment] = EARLIER(customer[c_mktsegment]) && EARLIER(customer[c_acctbal]) > customer[c_acctbal]), customer[c_acctbal])",
    "richer_in_building": 'COUNTROWS(FILTER(customer, customer[c_mktsegment] = "BUILDING" && customer[c_acctbal] >= EARLIER(customer[c_acctbal])))',
}


@query("""SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place, count(*) OVER (PARTITION BY c_nationkey) AS peers,
    max(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS nearest_below,
    CAST(coalesce(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) OVER (ORDER BY c_acctbal DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS richer_in_building FROM customer""")
def rank_by_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rowcontext.calculated(samples.view(spark, sf_dir), "customer", RANKED)
    return rows.select(F.col("customer__c_custkey").alias("c_custkey"), F.col("place").cast("long"), F.col("peers").cast("long"), "nearest_below", F.col("richer_in_building").cast("long"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS spent, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey IS NOT NULL")
def spent_by_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "FILTER(orders, orders[o_custkey] = EARLIER(orders[o_custkey]) && orders[o_orderkey] <= EARLIER(orders[o_orderkey]))"
    rows = rowcontext.calculated(samples.view(spark, sf_dir), "orders", {"spent": f"SUMX({own}, orders[o_totalprice])", "n": f"COUNTROWS({own})"}).where("orders__o_custkey is not null")
    return rows.select(F.col("orders__o_orderkey").alias("o_orderkey"), F.round("spent", 2).alias("spent"), F.col("n").cast("long"))


def queries() -> dict[str, Query]:
    return {k: _as_text(f, DATES[k]) if k in DATES else f for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    text = lambda k: ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES[k])
    return {k: f"SELECT * REPLACE ({text(k)}) FROM ({s})" if k in DATES else s for k, s in SQL.items()}
