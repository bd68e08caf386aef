"""The sample model over the TPC-H-like tables, and its sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.model import Column, Measure, Relationship, SemanticModel, Table


def _columns(text: str) -> tuple[Column, ...]:
    return tuple(Column(*x.split(":")) for x in text.split())


MEASURES = {
    "Total Revenue": "SUM(lineitem[l_extendedprice])",
    "Net Revenue": "SUMX(lineitem, lineitem[l_extendedprice] * (1 - lineitem[l_discount]))",
    "Quantity": "SUM(lineitem[l_quantity])",
    "Lines": "COUNTROWS(lineitem)",
    "Average Discount": "AVERAGE(lineitem[l_discount])",
    "Lowest Price": "MIN(lineitem[l_extendedprice])",
    "Highest Price": "MAX(lineitem[l_extendedprice])",
    "Suppliers": "DISTINCTCOUNTNOBLANK(lineitem[l_suppkey])",
    "Customers": "COUNTROWS(SUMMARIZE(lineitem, orders[o_custkey]))",  # of the lines, not of all orders
    "Revenue per Unit": "DIVIDE([Total Revenue], [Quantity], 0)",
    "Discount Given": "[Total Revenue] - [Net Revenue]",
    "Returned Revenue": 'CALCULATE([Total Revenue], lineitem[l_returnflag] = "R")',
    "Open Revenue": 'CALCULATE(SUM(lineitem[l_extendedprice]), lineitem[l_linestatus] IN {"O"})',
    "Returned Net Share": 'CALCULATE(DIVIDE([Net Revenue], [Total Revenue]), lineitem[l_returnflag] = "R" && lineitem[l_discount] > 0.02)',
    "Big Lines": "COUNTROWS(FILTER(lineitem, lineitem[l_quantity] >= 40))",
    "Weighted Price": "SUMX(lineitem, lineitem[l_quantity] * lineitem[l_extendedprice])",
    "Average Order Revenue": "AVERAGEX(VALUES(lineitem[l_orderkey]), [Total Revenue])",
    "Revenue Band": 'VAR r = [Total Revenue] VAR n = [Lines] RETURN IF(DIVIDE(r, n) > 25000, "high", SWITCH(TRUE(), DIVIDE(r, n) > 20000, "mid", "low"))',
    "Revenue All Regions": "CALCULATE([Total Revenue], ALL(region))",
    "Share of Regions": "DIVIDE([Total Revenue], CALCULATE([Total Revenue], ALL(region)))",
    "Share of Everything": "DIVIDE([Total Revenue], CALCULATE([Total Revenue], ALL()))",
    "Suppliers Everywhere": "CALCULATE([Suppliers], ALL(region))",
    "Share within Region": "DIVIDE([Total Revenue], CALCULATE([Total Revenue], ALLEXCEPT(lineitem, region[r_name])))",
    "Revenue Prior Year": "CALCULATE([Total Revenue], SAMEPERIODLASTYEAR('Date'[Date]))",
    "Revenue Prior Month": "CALCULATE([Total Revenue], DATEADD('Date'[Date], -1, MONTH))",
    "Revenue Next Month": "CALCULATE([Total Revenue], NEXTMONTH('Date'[Date]))",
    "Revenue YoY": "[Total Revenue] - CALCULATE([Total Revenue], SAMEPERIODLASTYEAR('Date'[Date]))",
    "Revenue YoY Pct": "DIVIDE([Revenue YoY], [Revenue Prior Year])",
    "Revenue YTD": "TOTALYTD([Total Revenue], 'Date'[Date])",
    "Revenue QTD": "TOTALQTD([Total Revenue], 'Date'[Date])",
    "Net Share YTD": "TOTALYTD(DIVIDE([Net Revenue], [Total Revenue]), 'Date'[Date])",
    "Revenue Rolling 3M": "CALCULATE([Total Revenue], DATESINPERIOD('Date'[Date], MAX('Date'[Date]), -3, MONTH))",
    "Revenue Shipped": "CALCULATE([Total Revenue], USERELATIONSHIP(lineitem[ship_date], 'Date'[Date]))",
    "Revenue 1996": "CALCULATE([Total Revenue], DATESBETWEEN('Date'[Date], DATE(1996, 1, 1), DATE(1996, 12, 31)))",
    "Supplier Nation Revenue": "CALCULATE([Total Revenue], TREATAS(VALUES(supplier[s_suppkey]), lineitem[l_suppkey]))",
    "Large Order Average": "AVERAGEX(FILTER(VALUES(lineitem[l_orderkey]), [Total Revenue] > 100000), [Total Revenue])",
    "Revenue of Big Orders": "CALCULATE([Total Revenue], FILTER(VALUES(lineitem[l_orderkey]), [Lines] >= 6))",
    "Revenue Last 30 Days": "CALCULATE([Total Revenue], DATESINPERIOD('Date'[Date], MAX('Date'[Date]), -30, DAY))",
    "Revenue Whole Prior Year": "CALCULATE([Total Revenue], PREVIOUSYEAR('Date'[Date]))",
    "Revenue Quarter Before": "CALCULATE([Total Revenue], PARALLELPERIOD('Date'[Date], -1, QUARTER))",
    "Revenue Next Quarter": "CALCULATE([Total Revenue], NEXTQUARTER('Date'[Date]))",
    "Revenue Day Before": "CALCULATE([Total Revenue], PREVIOUSDAY('Date'[Date]))",
    "Revenue Next Day": "CALCULATE([Total Revenue], NEXTDAY('Date'[Date]))",
    "Revenue Week Before": "CALCULATE([Total Revenue], DATEADD('Date'[Date], -7, DAY))",
    "Opening Revenue": "OPENINGBALANCEMONTH([Total Revenue], 'Date'[Date])",
    "Closing Revenue": "CLOSINGBALANCEMONTH([Total Revenue], 'Date'[Date])",
    "Suppliers YTD": "TOTALYTD([Suppliers], 'Date'[Date])",
    "Brand Position": "RANKX(ALL(part[p_brand]), [Total Revenue], , DESC, DENSE)",
    "Top Customers Revenue": "SUMX(TOPN(3, VALUES(customer[c_custkey]), [Total Revenue]), [Total Revenue])",
    "Last Order Value": "LASTNONBLANKVALUE('Date'[Date], [Total Revenue])",
    "Revenue on Last Return": "CALCULATE([Total Revenue], LASTNONBLANK('Date'[Date], [Returned Revenue]))",
    "Flag Pairs": "COUNTROWS(CROSSJOIN(VALUES(lineitem[l_returnflag]), VALUES(lineitem[l_linestatus])))",
    "Asian Revenue": 'CALCULATE([Total Revenue], LOOKUPVALUE(region[r_name], region[r_regionkey], nation[n_regionkey]) = "ASIA")',
    "First Order": "FIRSTDATE(orders[order_date])",
    "Last Order": "LASTDATE(orders[order_date])",
    "Flags": 'CONCATENATEX(VALUES(lineitem[l_returnflag]), lineitem[l_returnflag], "|")',
    # over other tables than the view's own, at their own grain
    "Balance": "SUM(customer[c_acctbal])",
    "Average Balance": "AVERAGE(customer[c_acctbal])",
    "Lowest Balance": "MIN(customer[c_acctbal])",
    "Highest Balance": "MAX(customer[c_acctbal])",
    "Customers on File": "COUNTROWS(customer)",
    "Customers in Credit": "COUNTROWS(FILTER(customer, customer[c_acctbal] > 5000))",
    "Balance by Nation Number": "SUMX(customer, customer[c_acctbal] * RELATED(nation[n_nationkey]))",
    "Segments on File": "DISTINCTCOUNT(customer[c_mktsegment])",
    "Supplier Balance": "SUM(supplier[s_acctbal])",
    "Suppliers on File": "COUNTROWS(supplier)",
    "Revenue per Balance": "DIVIDE([Total Revenue], [Balance])",
    "Urgent Orders": 'CALCULATE([Orders], orders[o_orderpriority] = "1-URGENT")',
    "Balance of Returners": 'CALCULATE([Balance], lineitem[l_returnflag] = "R")',
    "Balance Everywhere": "CALCULATE([Balance], ALL(region))",
    "Balance of Everyone": "CALCULATE([Balance], ALL(customer))",
    "Order Total Prior Year": "CALCULATE([Order Total], SAMEPERIODLASTYEAR('Date'[Date]))",
    "Balance Prior Year": "CALCULATE([Balance], SAMEPERIODLASTYEAR('Date'[Date]))",
    "Balance of Segments": "AVERAGEX(VALUES(customer[c_mktsegment]), [Balance])",
    "Order Total YTD": "TOTALYTD([Order Total], 'Date'[Date])",
    # filters from the many side
    "Customers Who Ordered": "CALCULATE([Customers on File], CROSSFILTER(orders[o_custkey], customer[c_custkey], BOTH))",
    "Balance of Buyers": "CALCULATE([Balance], CROSSFILTER(orders[o_custkey], customer[c_custkey], BOTH), CROSSFILTER(lineitem[l_orderkey], orders[o_orderkey], BOTH))",
    "Balance of the Urgent": 'CALCULATE([Balance], orders[o_orderpriority] = "1-URGENT", CROSSFILTER(orders[o_custkey], customer[c_custkey], BOTH))',
    "Order Total over Lines": "CALCULATE([Order Total], CROSSFILTER(lineitem[l_orderkey], orders[o_orderkey], BOTH))",
    "Orders over Lines": "CALCULATE([Orders], CROSSFILTER(lineitem[l_orderkey], orders[o_orderkey], BOTH))",
    # up to the last visible value
    "Revenue to Now": "CALCULATE([Total Revenue], FILTER(ALL('Date'), 'Date'[Date] <= MAX('Date'[Date])))",
    "Revenue to Now by Variable": "VAR last = MAX('Date'[Date]) RETURN CALCULATE([Total Revenue], FILTER(ALL('Date'[Date]), last >= 'Date'[Date]))",
    "Revenue to Now by Bounds": "CALCULATE([Total Revenue], DATESBETWEEN('Date'[Date], BLANK(), MAX('Date'[Date])))",
    "Revenue before Now": "CALCULATE([Total Revenue], 'Date'[Date] < MIN('Date'[Date]))",
    "Revenue YTD by Filter": "CALCULATE([Total Revenue], FILTER(ALL('Date'), 'Date'[Year] = MAX('Date'[Year]) && 'Date'[Date] <= MAX('Date'[Date])))",
    "Revenue 90 Days by Filter": "CALCULATE([Total Revenue], FILTER(ALL('Date'), 'Date'[Date] > MAX('Date'[Date]) - 90 && 'Date'[Date] <= MAX('Date'[Date])))",
    "Revenue to Now a Year Ago": "CALCULATE([Revenue to Now], SAMEPERIODLASTYEAR('Date'[Date]))",
    "Suppliers to Now": "CALCULATE([Suppliers], FILTER(ALL('Date'), 'Date'[Date] <= MAX('Date'[Date])))",
    "Highest Price to Now": "CALCULATE([Highest Price], FILTER(ALL('Date'), 'Date'[Date] <= MAX('Date'[Date])))",
    "Average Discount YTD": "TOTALYTD([Average Discount], 'Date'[Date])",
    "Orders to Now": "CALCULATE([Orders], FILTER(ALL('Date'), 'Date'[Date] <= MAX('Date'[Date])))",
    "Revenue up to Size": "CALCULATE([Total Revenue], FILTER(ALL(part[p_size]), part[p_size] <= MAX(part[p_size])))",
    "Lines up to Price": "CALCULATE([Lines], FILTER(ALL(part[p_retailprice]), part[p_retailprice] <= MAX(part[p_retailprice])))",
    "Customers to Date": "TOTALYTD(DISTINCTCOUNT(orders[o_custkey]), 'Date'[Date])",
}
EVENT_MEASURES = {
    "Events": "COUNTROWS(events)",
    "Event Value": "SUM(events[value])",
    "Blank Values": "COUNTBLANK(events[value])",
    "Users": "DISTINCTCOUNTNOBLANK(events[user_id])",
    "Last Value": "LASTNONBLANKVALUE(events[ts], MAX(events[value]))",
    "Last Purchase Value": 'CALCULATE([Last Value], events[event_type] = "purchase")',
}


def _measures(found: dict[str, str]) -> tuple[Measure, ...]:
    return tuple(Measure(k, v) for k, v in found.items())


def model() -> SemanticModel:
    geography = ("nation", "n_nationkey:int64 n_name:string n_regionkey:int64")
    tables = (
        Table("lineitem", "lineitem", (*_columns("l_orderkey:int64 l_partkey:int64 l_suppkey:int64 l_linenumber:int64 l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:dateTime"), Column("ship_date", "date", "to_date(l_shipdate)")), _measures(MEASURES)),
        Table("orders", "orders", (*_columns("o_orderkey:int64 o_custkey:int64 o_orderstatus:string o_totalprice:double o_orderdate:dateTime o_orderpriority:string"), Column("order_date", "date", "to_date(o_orderdate)")), (Measure("Order Total", "SUM(orders[o_totalprice])"), Measure("Orders", "COUNTROWS(orders)"), Measure("Customers Ordering", "DISTINCTCOUNTNOBLANK(orders[o_custkey])"))),
        Table("customer", "customer", _columns("c_custkey:int64 c_name:string c_nationkey:int64 c_acctbal:double c_mktsegment:string")),
        Table("nation", "nation", _columns(geography[1]), hierarchies=(("Geography", ("n_regionkey", "n_name")),)),
        Table("region", "region", _columns("r_regionkey:int64 r_name:string")),
        Table("part", "part", _columns("p_partkey:int64 p_name:string p_brand:string p_type:string p_size:int64 p_retailprice:double")),
        Table("supplier", "supplier", _columns("s_suppkey:int64 s_name:string s_nationkey:int64 s_acctbal:double"), (Measure("Names by Balance", 'CONCATENATEX(FILTER(supplier, supplier[s_acctbal] > 0), supplier[s_name], ";", supplier[s_acctbal], DESC)'),)),
        Table("SupplierNation", "nation", _columns(geography[1])),
        Table("Date", "calendar", _columns("Date:date Year:int64 Quarter:int64 Month:int64")),
        Table("events", "events", _columns("event_id:int64 ts:dateTime user_id:int64 event_type:string value:double props:string"), _measures(EVENT_MEASURES)),
    )
    keys = (
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("nation", "n_regionkey", "region", "r_regionkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("supplier", "s_nationkey", "SupplierNation", "n_nationkey"), ("orders", "order_date", "Date", "Date"),
    )
    relationships = (*[Relationship(*k) for k in keys], Relationship("lineitem", "ship_date", "Date", "Date", is_active=False))
    return SemanticModel("sales", tables, relationships)


def calendar(spark: SparkSession, first: str = "1992-01-01", last: str = "2005-12-31") -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("Date"))
    return days.select("Date", F.year("Date").alias("Year"), F.quarter("Date").alias("Quarter"), F.month("Date").alias("Month"))


def source(spark: SparkSession, sf_dir: str) -> Callable[[Table], DataFrame]:
    return lambda t: calendar(spark) if t.source == "calendar" else spark.read.parquet(f"{sf_dir}/{t.source}.parquet")


def view(spark: SparkSession, sf_dir: str, fact: str = "lineitem", **options):
    from starweave.plans.metricview import MetricView

    v = MetricView(model(), fact, source(spark, sf_dir), **options)
    if fact in ("lineitem", "orders"):
        v.with_dimension("Region", "region", "r_name").with_dimension("Nation", "nation", "n_name").with_dimension("Segment", "customer", "c_mktsegment")
        v.with_dimension("Order Year", "Date", "Date", "year").with_dimension("Order Month", "Date", "Date", "month").with_dimension("Order Quarter", "Date", "Date", "quarter").with_dimension("Order Day", "Date", "Date", "date")
        v.with_dimension("Brand", "part", "p_brand").with_dimension("Supplier Nation", "SupplierNation", "n_name")
    return v
