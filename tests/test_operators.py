import datetime

import pytest
from pyspark.sql import functions as F

from starweave import model, samples
from starweave.operators import timeintel, validation
from starweave.plans.dax import DaxError
from starweave.plans.metricview import MetricView
from starweave.streaming import views

FOLDER = "/root/testdata/sf0.001"


def day(text):
    return datetime.date.fromisoformat(text)


def test_only_needed_tables_are_joined(spark):
    v = samples.view(spark, FOLDER)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(v.query(["l_returnflag"], ["Total Revenue"])) == 0
    assert joins(v.query(["Brand"], ["Total Revenue"])) == 1
    assert joins(v.query(["Region"], ["Total Revenue"])) == 4


def test_filtered_measures_share_one_scan(spark):
    plan = samples.view(spark, FOLDER).query(["l_linestatus"], ["Returned Revenue", "Open Revenue", "Big Lines", "Total Revenue"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_groups_add_up_to_the_total(spark):
    v = samples.view(spark, FOLDER)
    total = v.query([], ["Total Revenue", "Lines"]).first()
    for dims in (["Region"], ["Nation", "Brand"], ["Order Month"]):
        r = v.query(dims, ["Total Revenue", "Lines"]).agg(F.sum("Total Revenue"), F.sum("Lines")).first()
        assert r[0] == pytest.approx(total[0])
        assert r[1] == total[1]


def small(spark, rows, measures, relationships=()):
    fact = model.Table("F", "f", tuple(model.Column(c) for c in ("k", "g", "v")) + (model.Column("d", "date"),), tuple(model.Measure(n, e) for n, e in measures.items()))
    dim = model.Table("D", "d", (model.Column("k"), model.Column("name")))
    frames = {"f": spark.createDataFrame(rows, "k int, g string, v double, d date"), "d": spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")}
    m = model.SemanticModel("m", (fact, dim), tuple(relationships) or (model.Relationship("F", "k", "D", "k"),))
    return MetricView(m, "F", lambda t: frames[t.source]).with_dimension("Month", "F", "d", "month")


def test_blanks_zeros_and_unmatched_keys(spark):
    rows = [(1, "a", 1.0, day("2024-01-05")), (1, "a", None, day("2024-01-06")), (9, None, 0.0, None), (None, "b", -2.0, day("2024-03-01"))]
    v = small(spark, rows, {"S": "SUM(F[v])", "Q": "DIVIDE([S], SUM(F[k]))", "B": "COUNTBLANK(F[v])", "N": "DISTINCTCOUNT(F[k])", "NB": "DISTINCTCOUNTNOBLANK(F[k])", "Z": "IF(ISBLANK([S]), -1, [S])", "T": 'FORMAT([S], "0.00")'})
    got = {r["name"]: r for r in v.query(["name"], ["S", "Q", "B", "Z", "T"]).collect()}
    assert set(got) == {"one", None}
    assert (got["one"].S, got["one"].B, got["one"].T) == (1.0, 1, "1.00")
    assert got[None].S == -2.0
    one = v.query([], ["N", "NB"]).first()
    assert (one.N, one.NB) == (3, 2)
    assert v.query(["g"], ["S"], where='F[g] = "none"').count() == 0
    assert v.query([], ["S", "B"], where='F[g] = "none"').first().S is None


def test_shifts_go_by_period_not_by_row(spark):
    rows = [(1, "a", 10.0, day("2023-01-15")), (1, "a", 7.0, day("2024-01-20")), (1, "a", 5.0, day("2024-03-02"))]
    v = small(spark, rows, {"S": "SUM(F[v])", "P": "CALCULATE([S], SAMEPERIODLASTYEAR(F[d]))", "M": "CALCULATE([S], PREVIOUSMONTH(F[d]))", "R": "CALCULATE([S], DATESINPERIOD(F[d], MAX(F[d]), -2, MONTH))"})
    got = {str(r.Month): r for r in v.query(["Month"], ["S", "P", "M", "R"]).collect()}
    assert (got["2024-01-01"].P, got["2024-03-01"].P, got["2024-03-01"].M, got["2024-03-01"].R) == (10.0, None, None, 5.0)


def test_rejections_name_the_reason(spark):
    v = small(spark, [], {"A": "SELECTEDVALUE(F[g])", "C": "[C] + 1", "U": "SUM(F[nope])", "X": "F[v]", "P": "CALCULATE(SUM(F[v]), SAMEPERIODLASTYEAR(F[d]))", "Y": "TOTALYTD(DISTINCTCOUNTNOBLANK(F[g]), F[d])"})
    for m, why in {"A": "selection", "C": "itself", "U": "unknown column", "X": "outside", "P": "date dimension", "nope": "unknown measure"}.items():
        with pytest.raises(DaxError, match=why):
            v.query(["g"], [m])
    with pytest.raises(DaxError, match="unknown dimension"):
        v.query(["zz"], ["P"])


def test_running_distinct_counts(spark):
    rows = [(1, g, 1.0, day(d)) for g, d in (("a", "2024-01-05"), ("b", "2024-01-09"), ("a", "2024-03-01"), ("c", "2024-03-02"), ("a", "2025-01-01"))]
    v = small(spark, rows, {"Y": "TOTALYTD(DISTINCTCOUNTNOBLANK(F[g]), F[d])", "A": "TOTALYTD(AVERAGE(F[k]), F[d])"})
    assert [tuple(r)[1:] for r in v.query(["Month"], ["Y", "A"]).orderBy("Month").collect()] == [(2, 1.0), (3, 1.0), (1, 1.0)]


def test_time_functions_change_the_visible_days(spark):
    rows = [(1, "a", float(i + 1), day(d)) for i, d in enumerate(("2023-12-31", "2024-01-31", "2024-02-29", "2024-03-01", "2024-06-30", "2025-02-28"))]
    c = lambda e: f"CALCULATE(SUM(F[v]), {e})"
    v = small(spark, rows, {
        "S": "SUM(F[v])", "D": c("DATEADD(F[d], -1, DAY)"), "PD": c("PREVIOUSDAY(F[d])"), "PY": c("PREVIOUSYEAR(F[d])"), "NQ": c("NEXTQUARTER(F[d])"), "PP": c("PARALLELPERIOD(F[d], -1, QUARTER)"),
        "T": c("DATESINPERIOD(F[d], MAX(F[d]), -30, DAY)"), "O": "OPENINGBALANCEMONTH(SUM(F[v]), F[d])", "C": "CLOSINGBALANCEQUARTER(SUM(F[v]), F[d])", "SY": c("SAMEPERIODLASTYEAR(F[d])"), "YP": c("SAMEPERIODLASTYEAR(DATESYTD(F[d]))"), "F": c("FIRSTDATE(F[d])"),
    })
    names = ["S", "D", "PD", "PY", "NQ", "PP", "T", "O", "C", "SY", "YP", "F"]
    got = {str(r.Month)[:7]: {n: r[n] for n in names if r[n] is not None} for r in v.query(["Month"], names).collect()}
    assert got["2024-02"] == {"S": 3.0, "D": 2.0, "PD": 2.0, "PY": 1.0, "NQ": 5.0, "PP": 1.0, "T": 5.0, "O": 2.0}
    assert got["2024-03"] == {"S": 4.0, "D": 7.0, "PD": 3.0, "PY": 1.0, "NQ": 5.0, "PP": 1.0, "O": 3.0, "F": 4.0}
    assert got["2025-02"] == {"S": 6.0, "PY": 14.0, "SY": 3.0, "YP": 5.0, "T": 6.0}
    one = v.query([], ["S", "PY", "SY"], where="F[d] >= DATE(2025, 2, 1) && F[d] <= DATE(2025, 2, 28)").first()
    assert tuple(one) == (6.0, 14.0, 3.0)


def test_calculation_items(spark):
    v = samples.view(spark, FOLDER, calculation_items={"Double": "SELECTEDMEASURE() * 2"})
    v.with_measure("Twice", v.calculation_item("Double", "Lines"))
    assert v.query([], ["Twice"]).first()[0] == 2 * v.query([], ["Lines"]).first()[0]


def test_text_flags_and_cleaning(spark):
    rows = spark.createDataFrame([("1,200.5", "2024-01-02", "x", "yes"), ("-3", "2024-02-30", "1", "no"), ("", None, "y", None)], "a string, b string, c string, d string")
    flags = {r.column: r.issue for r in validation.text_flags(rows).collect()}
    assert flags == {"a": "varchar_numeric", "b": "string_date"}
    assert [tuple(r)[:2] for r in validation.cleaned(rows, flags).collect()] == [(1200.5, day("2024-01-02")), (-3.0, None), (None, None)]
    assert {r.kind: r.n for r in validation.type_mix(rows, "b").collect()} == {"date": 2, "null": 1}


def test_matching_of_tables_and_columns(spark):
    names = spark.createDataFrame([("FactSales",), ("Customer",), ("Seeded",), ("Nowhere",)], "name string")
    found = spark.createDataFrame([("c.s.fact_sales",), ("c.s.dim_customer",), ("c.s.other",)], "physical string")
    got = {r.name: (r.physical, r.how) for r in validation.matched_tables(names, found, {"Seeded": "c.s.other"}).collect()}
    assert got == {"FactSales": ("c.s.fact_sales", "exact"), "Customer": ("c.s.dim_customer", "contains"), "Seeded": ("c.s.other", "seed"), "Nowhere": (None, "none")}
    rows = spark.createDataFrame([], "o_orderkey int, o_custkey string, o_totalprice decimal(10,2), o_orderdate date")
    got = {r.column: r.verdict for r in validation.reconcile_columns(samples.model(), "orders", rows).collect()}
    assert got == {"o_orderkey": "ok", "o_custkey": "type differs", "o_totalprice": "ok", "o_orderdate": "ok", "o_orderstatus": "missing", "o_orderpriority": "missing"}


def test_parity_and_scores(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None), (None, 3.0), ("only", 1.0), ("z", 100000.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.005), ("y", None), (None, 4.0), ("z", 100005.0)], "k string, v double")
    got = {r.k: r.matches for r in validation.parity(a, b, ["k"], "v").collect()}
    assert got == {"x": True, "y": True, None: False, "only": False, "z": True}
    assert validation.first_differences(validation.parity(a, b, ["k"], "v"), ["k"], 1).count() == 1
    scores = spark.createDataFrame([("a", 85), ("b", 20), ("c", 85), ("d", 50)], "name string, score int")
    seen = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("c", False)], "name string, matches boolean")
    assert {r.name: r.score for r in validation.rescored(scores, seen).collect()} == {"a": 95, "b": 80, "c": 40, "d": 50}


def test_reviews_and_comparisons(spark):
    rows = [("A1", "HIGH", "x"), ("B2", "CRITICAL", "y"), ("C", "LOW", "z")]
    found = spark.createDataFrame(rows, "finding string, severity string, object string")
    r = validation.review(found).first()
    assert (r.score, r.verdict) == (64, "REJECT")
    assert validation.review(found.where("false")).first().verdict == "APPROVE"
    assert validation.ranked_findings(found).first().severity == "CRITICAL"
    t = spark.createDataFrame([("a", "SUM( x )"), ("b", "1"), ("c", "2")], "name string, expression string")
    f = spark.createDataFrame([("a", "SUM(  x )"), ("b", "9"), ("d", "2")], "name string, expression string")
    assert {r.name: r.state for r in validation.fidelity(t, f).collect()} == {"a": "same", "b": "altered", "c": "dropped", "d": "extra"}
    e = spark.createDataFrame([("A", "b"), ("c", "d")], "src string, dst string")
    g = spark.createDataFrame([("a", "B"), ("x", "y")], "src string, dst string")
    r = validation.edge_recall(e, g).first()
    assert (r.n_truth, r.n_found, r.n_extra, r.recall) == (2, 1, 1, 0.5)
    edits = spark.createDataFrame([("a", "new", False), ("b", None, True)], "name string, new_sql string, drop boolean")
    now = spark.createDataFrame([("a", "old", "auto"), ("b", "old", "auto"), ("c", "old", "auto")], "name string, sql string, status string")
    assert {tuple(r) for r in validation.change_request(now, edits).collect()} == {("a", "new", "reviewed"), ("b", "old", "dropped"), ("c", "old", "auto")}
    one = model.frames(spark, samples.model())["relationships"]
    other = one.withColumn("cardinality", F.when(F.col("to_table") == "part", "MANY_TO_MANY").otherwise(F.col("cardinality")))
    assert validation.property_agreement(one, other).first().differs == ["cardinality"]
    hidden = validation.redacted(t.withColumn("model", F.lit("secret")), "salt", "name").first()
    assert hidden.model == "model_1"
    assert hidden.name != "a"
    card = validation.scorecard(spark.createDataFrame([("m", 4, 3), ("m", 0, 0)], "counter string, expected int, found int")).first()
    assert card.ratio == 0.75
    s = validation.gap_severity(spark.createDataFrame([("none", None), ("exact", "missing"), ("exact", "type differs"), ("exact", "ok")], "how string, verdict string"))
    assert [r.severity for r in s.collect()] == ["BLOCKER", "HIGH", "MEDIUM", None]


def test_time_operators(spark):
    rows = spark.createDataFrame([(day(f"2024-{m:02d}-01"), v) for m, v in ((1, 1.0), (2, 2.0), (4, 4.0), (5, None))], "month date, v double")
    assert timeintel.densified(rows, "month").count() == 5
    got = [r.running for r in timeintel.running(rows, "month", "v", "quarter").orderBy("month").collect()]
    assert got == [1.0, 3.0, 4.0, 4.0]
    w = timeintel.window_measure(rows, "month", "v", trailing=2, unit="months", inclusive=True, name="w").orderBy("month").collect()
    assert [r.w for r in w] == [1.0, 3.0, 4.0, 4.0]
    last = timeintel.window_measure(rows, "month", "v", semiadditive="last", name="w").orderBy("month").collect()
    assert [r.w for r in last] == [1.0, 2.0, 4.0, 4.0]
    s = timeintel.shifted(rows, "month", ["v"], -1).orderBy("month").collect()
    assert [r.v_prior for r in s] == [None, 1.0, None, 4.0]
    shares = timeintel.share_of(rows, "v").collect()
    assert sum(r.share or 0 for r in shares) == pytest.approx(1)
    ly = timeintel.calendar(spark, "2024-02-28", "2024-03-01").orderBy("date_key").collect()
    assert [str(r.date_key_ly) for r in ly] == ["2023-02-28", "2023-02-28", "2023-03-01"]


def test_stream_equals_batch(spark, tmp_path):
    v = samples.view(spark, FOLDER, "events")
    rows = spark.read.parquet(f"{FOLDER}/events.parquet")
    far = rows.limit(1).select(F.lit(10**9).alias("event_id"), (F.max("ts").over(__import__("pyspark").sql.Window.partitionBy(F.lit(0))) + F.expr("interval 4000 days")).alias("ts"), *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[2:]])
    rows.unionByName(far).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = views.windowed(v, views.stream(spark, str(tmp_path), "events"), "ts", ["Events", "Event Value"], ["event_type"], "1 day", "0 seconds")
    q = views.start(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("event_type").agg(F.sum("Events").alias("n"), F.round(F.sum("Event Value"), 2).alias("v"))
    want = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    assert sorted(map(tuple, got.where("event_type is not null").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(DaxError):
        views.windowed(v, rows, "ts", ["Users"])


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_leaf_reads_its_own_table_alone(spark):
    v = samples.view(spark, FOLDER)
    text = plan_of(v.query(["Region"], ["Balance", "Customers on File"]))
    assert "lineitem" not in text and "orders" not in text and text.count("Join ") == 2
    assert "customer" not in plan_of(v.query(["l_returnflag"], ["Total Revenue"]))


def test_dimension_rows_count_once(spark):
    rows = [(1, "a", 1.0, day("2024-01-05")), (1, "a", 2.0, day("2024-01-06")), (2, "b", 4.0, day("2024-02-01")), (9, "b", 8.0, None)]
    v = small(spark, rows, {"S": "SUM(F[v])", "K": "SUM(D[k])", "X": "SUMX(D, D[k] * 10)", "N": "COUNTROWS(D)", "A": 'CALCULATE(SUM(D[k]), D[name] = "two")', "R": "DIVIDE([S], [K])", "O": "CALCULATE(SUM(D[k]), F[v] > 3)"})
    total = v.query([], ["S", "K", "X", "N", "A", "O"]).first()
    assert (total.S, total.K, total.X, total.N, total.A, total.O) == (15.0, 3, 30, 2, 2, 3)
    got = {r["name"]: r for r in v.query(["name"], ["S", "K", "R"]).collect()}
    assert {k: (r.S, r.K) for k, r in got.items()} == {"one": (3.0, 1), "two": (4.0, 2), None: (8.0, None)}
    by_g = {r.g: (r.K, r.S) for r in v.query(["g"], ["K", "S"]).collect()}  # no way from D to F's column
    assert by_g == {"a": (3, 3.0), "b": (3, 12.0)}
    assert {r["name"]: r.K for r in v.query(["name"], ["K"], where='F[g] = "a"').collect()} == {"one": 1, "two": 2}
    with pytest.raises(DaxError, match="only in part"):
        v.query(["name"], ["K"], where='F[g] = D[name]')


def test_groups_of_all_facts_are_there(spark):
    """A group that one table has and another doesn't."""
    v = small(spark, [(1, "a", 1.0, None)], {"S": "SUM(F[v])", "N": "COUNTROWS(D)"})
    assert sorted((r["name"], r.S, r.N) for r in v.query(["name"], ["S", "N"]).collect()) == [("one", 1.0, 1), ("two", None, 1)]
    assert [r["name"] for r in v.query(["name"], ["S"]).collect()] == ["one"]


OPEN = {
    "S": "SUM(F[v])", "C": "CALCULATE([S], FILTER(ALL(F[d]), F[d] <= MAX(F[d])))", "N": "CALCULATE(DISTINCTCOUNTNOBLANK(F[g]), FILTER(ALL(F[d]), F[d] <= MAX(F[d])))",
    "L": "CALCULATE(MIN(F[v]), FILTER(ALL(F[d]), F[d] <= MAX(F[d])))", "B": "CALCULATE([S], F[d] < MIN(F[d]))", "Q": "CALCULATE(COUNT(F[v]), FILTER(ALL(F[d]), F[d] <= MAX(F[d])))", "Z": "TOTALYTD(DISTINCTCOUNT(F[g]), F[d])",
}


def test_open_contexts_by_hand(spark):
    rows = [(1, "a", 5.0, day("2023-12-31")), (1, "b", None, day("2024-01-05")), (1, "a", 2.0, day("2024-01-20")), (2, "c", -1.0, day("2024-03-02")), (2, None, 3.0, day("2024-03-03")), (2, "z", 100.0, None)]
    v = small(spark, rows, OPEN)
    got = {str(r.Month): (r.C, r.N, r.L, r.B, r.Q, r.Z) for r in v.query(["Month"], [*OPEN]).collect()}
    assert got == {
        "2023-12-01": (5.0, 1, 5.0, None, 1, 1), "2024-01-01": (7.0, 2, 2.0, 5.0, 2, 2), "2024-03-01": (9.0, 3, -1.0, 7.0, 4, 4), "None": (None, None, None, None, None, None),
    }
    by_k = {(r.k, str(r.Month)): (r.C, r.N) for r in v.query(["k", "Month"], ["C", "N"]).collect()}
    assert by_k[(2, "2024-03-01")] == (2.0, 1) and by_k[(1, "2024-01-01")] == (7.0, 2)


def test_running_sums_join_no_days(spark):
    v = samples.view(spark, FOLDER)
    joins = lambda m: plan_of(v.query(["Order Month"], [m])).count("Join ")
    assert joins("Revenue to Now") <= joins("Total Revenue") * 2 + 1  # both contexts' joins, and one of their results
    assert "sequence" not in plan_of(v.query(["Order Month"], ["Revenue to Now", "Suppliers YTD"]))


def test_conditions_that_are_not_known(spark):
    v = small(spark, [], {"M": "SUMX(F, MAX(F[v]))", "P": "CALCULATE(SUM(F[v]), FILTER(F, F[v] > MAX(F[v])))", "T": "CALCULATE(SUM(F[v]), FILTER(ALL(F[d]), F[d] <= MAX(F[d]) && D[name] = \"one\"))", "R": "CALCULATE(SUM(F[v]), F[v] < MAX(F[v]))"})
    for name, why in {"M": "MAX with 1 arguments", "P": "MAX with 1 arguments", "T": "in a condition over F", "R": "up to MAX"}.items():
        with pytest.raises(DaxError, match=why):
            v.query(["Month"], [name])


def test_running_totals_over_parts(spark):
    import random

    from starweave.plans.metricview import running_totals

    rng = random.Random(3)
    rows = [(k, x, rng.choice([None, rng.randrange(-50, 50)]), rng.randrange(100)) for k in ("a", None, "b") for x in rng.sample(range(3000), 700 if k == "a" else 40)]
    df = spark.createDataFrame(rows, "k string, x int, s long, m int")
    got = {(r.k, r.x): (r.s, r.m) for r in running_totals(df, ["k"], "x", {"s": F.sum, "m": F.min}).collect()}
    for k, x, *_ in rows:
        before = [r for r in rows if r[0] == k and r[1] <= x]
        s = [r[2] for r in before if r[2] is not None]
        assert got[(k, x)] == (sum(s) if s else None, min(r[3] for r in before))
    assert running_totals(df.where("false"), ["k"], "x", {"s": F.sum}).count() == 0


def fact_scans(df):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("FileScan" in line and "lineitem.parquet" in line for line in final.splitlines())


@pytest.mark.parametrize("dims, measures", [
    (["Order Month"], ["Total Revenue", "Revenue YTD", "Share of Everything", "Revenue YoY"]),
    (["Region"], ["Suppliers", "Suppliers Everywhere"]),
    (["Order Month"], ["Revenue YTD", "Revenue QTD", "Revenue to Now"]),
    (["Region", "Order Year"], ["Lines", "Suppliers", "Suppliers YTD", "Suppliers Everywhere", "Share within Region"]),
])
def test_contexts_share_one_scan(spark, dims, measures):
    assert fact_scans(samples.view(spark, FOLDER).query(dims, measures)) == 1


def test_totals_of_no_rows(spark):
    """A filter that leaves nothing: totals are one row still, groups none."""
    v = samples.view(spark, FOLDER)
    names = ["Total Revenue", "Suppliers", "Suppliers Everywhere", "Share of Everything", "Lines"]
    got = v.query([], names, where="lineitem[l_quantity] < 0").collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, None, 0)]
    assert v.query(["Region"], names, where="lineitem[l_quantity] < 0").count() == 0


def test_carried_values_and_latest_rows_by_hand(spark):
    import random

    rng = random.Random(8)
    rows = [(e, t, rng.choice([None, None, rng.randrange(9)])) for e in ("hot", "cold", None) for t in rng.sample(range(10_000), 900 if e == "hot" else 30)]
    df = spark.createDataFrame(rows, "e string, t int, v int")
    got = {(r.e, r.t): r.carried for r in timeintel.carried(df, "e", "t", "v").collect()}
    last = {(r.e, r.t, r.v) for r in timeintel.last_per_entity(df, ["e"], ["t"]).collect()}
    for e in ("hot", "cold", None):
        own, known = sorted((t, v) for x, t, v in rows if x == e), None
        for t, v in own:
            known = v if v is not None else known
            assert got[(e, t)] == known
        assert (e, *own[-1]) in last
    assert len(last) == 3 and len(got) == len(rows)
    assert timeintel.carried(df.where("false"), "e", "t", "v").count() == 0
    assert timeintel.last_per_entity(df, ["e"], ["t"]).columns == df.columns


def test_parameters_and_calls_of_queries():
    from starweave.sources import models

    assert models.parameter_value(' "td""prod" meta [IsParameterQuery=true, Type="Text"]') == 'td"prod'
    assert models.parameter_value('"x" META [Type="Text", isparameterquery = TRUE]') == "x"
    for other in ('"x"', '"x" meta [Type="Text"]', "let x = 1 in x", '"x" meta [IsParameterQuery=false]', None, "", '"x" meta'):
        assert models.parameter_value(other) is None
    text = 'let s = Teradata.Database( #"Host Name" , [HierarchicalNavigation=true]), t = s{[Schema = "EDW", Name="V_SALES"]}[Data] in t'
    assert models.source_hint(text, {"Host Name": "td.example.com"}) == "Teradata: td.example.com.EDW.V_SALES"
    assert models.source_hint(text, {}) == "Teradata: Host Name.EDW.V_SALES"
    for none in ("Teradata.Database", "Teradata.Database(", 'Teradata.Database("")', "Teradata.Database(1)", 'x("Teradata.Database(")'):
        assert models.source_hint(none, {}) is None


def bridged(spark, cross_filter="SINGLE"):
    """Accounts and owners, many to many: balances are of accounts, names of owners."""
    tables = {
        "f": ([(1, 10.0), (1, 5.0), (2, 7.0), (3, 1.0), (4, 100.0)], "k int, v double"), "d": ([(1, "x"), (2, "y"), (3, "z"), (4, "w")], "k int, kind string"),
        "g": ([(1, 1), (1, 2), (1, 2), (2, 2), (3, None), (None, 1)], "k int, o int"), "o": ([(1, "ann"), (2, "bob"), (3, "cy")], "o int, name string"),
    }
    frames = {n: spark.createDataFrame(*t) for n, t in tables.items()}
    named = {"f": "F", "d": "D", "g": "G", "o": "O"}
    measures = {"S": "SUM(F[v])", "B": "CALCULATE(SUM(F[v]), CROSSFILTER(G[k], D[k], BOTH))", "N": "CALCULATE(COUNTROWS(D), CROSSFILTER(D[k], G[k], BOTH))", "A": 'CALCULATE(SUM(F[v]), O[name] = "ann", CROSSFILTER(G[k], D[k], BOTH))'}
    found = tuple(model.Table(named[n], n, tuple(model.Column(c) for c in frames[n].columns), tuple(model.Measure(*m) for m in measures.items()) if n == "f" else ()) for n in named)
    rels = (model.Relationship("F", "k", "D", "k"), model.Relationship("G", "k", "D", "k", cross_filter=cross_filter), model.Relationship("G", "o", "O", "o"))
    return MetricView(model.SemanticModel("m", found, rels), "F", lambda t: frames[t.source]).with_dimension("Owner", "O", "name")


def test_measures_over_a_bridge(spark):
    v = bridged(spark)
    got = {r.Owner: (r.B, r.N) for r in v.query(["Owner"], ["B", "N"]).collect()}
    assert got == {"ann": (15.0, 1), "bob": (22.0, 2), None: (1.0, 1)}  # an account of two owners counts for each, once
    assert v.query([], ["B", "N", "A"]).first() == (123.0, 4, 15.0)
    assert {r.kind: (r.B, r.A) for r in v.query(["kind"], ["B", "A"]).collect()} == {"x": (15.0, 15.0), "y": (7.0, None), "z": (1.0, None), "w": (100.0, None)}
    assert v.query([], ["B"], where='O[name] = "bob"').first().B == 22.0
    total = {r.Owner: (r.B, r.S) for r in v.query(["Owner"], ["B", "S"]).collect()}
    assert total == {"ann": (15.0, 123.0), "bob": (22.0, 123.0), None: (1.0, 123.0)}
    with pytest.raises(DaxError, match="reached by all"):
        v.query(["Owner"], ["S"])
    with pytest.raises(DaxError, match="no such relationship"):
        v.with_measure("Q", "CALCULATE([S], CROSSFILTER(F[v], D[k], BOTH))").query([], ["Q"])


def test_relationships_in_both_directions(spark):
    assert {r.Owner: r.S for r in bridged(spark, "BOTH").query(["Owner"], ["S"]).collect()} == {"ann": 15.0, "bob": 22.0, None: 1.0}
