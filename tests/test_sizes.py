"""What shows in larger tables only, on small ones that have it."""

import random

import duckdb
from pyspark.sql import functions as F

from starweave import queries, samples
from starweave.model import Column, SemanticModel, Table
from starweave.operators import estate, scoring
from starweave.plans import rowcontext
from starweave.plans.dax import parse, references
from starweave.plans.metricview import MetricView, with_rank

SF = "/root/testdata/sf0.001"


def test_customers_of_lines_alone(spark, tmp_path):
    """Orders without lines, lines without orders: what counts are the customers of the lines, as in the SQL."""
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            rows = rows.where("l_orderkey % 3 != 0").withColumn("l_orderkey", F.expr("if(l_orderkey % 7 = 0, -l_orderkey - 1, l_orderkey)"))
        if t == "orders":
            rows = rows.withColumn("o_custkey", F.expr("if(o_custkey % 5 = 0, -o_custkey - 1, o_custkey)"))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "basic_aggregates_by_segment"
    got = {(r.segment, r.n_lines, r.suppliers, r.customers) for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(f"SELECT segment, n_lines, suppliers, customers FROM ({queries.oracle_sql()[name]})").fetchall())


def test_ranks_of_sums_that_differ_in_their_last_bits(spark):
    """Sums whose parts arrive in another order each time: no row is lost, and ranks stay."""
    noisy = F.udf(lambda x: x * (1 + random.random() * 1e-12), "double").asNondeterministic()
    rows = spark.range(500).select(F.col("id").alias("k"), noisy(F.col("id").cast("double") + 1).alias("v"))
    for dense in (True, False):
        got = with_rank(rows, "v", [], dense, "rank").collect()
        assert sorted((r.k, r["rank"]) for r in got) == [(k, 500 - k) for k in range(500)]


def test_positions_of_sums_that_differ_in_their_last_bits(spark, monkeypatch):
    noisy = F.udf(lambda x: x * (1 + random.random() * 1e-12), "double").asNondeterministic()
    evaluate = MetricView.evaluate

    def unsteady(*args, **options):
        rows = evaluate(*args, **options)
        return rows.withColumns({c: noisy(F.col(f"`{c}`")) for c, kind in rows.dtypes if kind == "double"})

    monkeypatch.setattr(MetricView, "evaluate", unsteady)
    rows = samples.view(spark, SF).query(["Brand"], ["Brand Position"]).collect()
    assert sorted(r["Brand Position"] for r in rows) == list(range(1, len(rows) + 1))


def test_expressions_of_one_shape_are_read_once(monkeypatch):
    forms = ["DIVIDE([{0}], COUNTROWS(Sales))", "VAR x = [{0}] RETURN x * SUMX(FILTER(Sales, Sales[{0}] = BLANK()), 1)", "CALCULATE(SUM([{0}]), 'A b'[{0}] > 3)", "IF(ISBLANK([{0}]), 0, [{0}]) = 0", "SUM((([{0}]"]
    calls = []
    monkeypatch.setattr(estate, "parse", lambda *a: calls.append(a) or parse(*a))
    for form in forms:
        for k in range(100):
            text = form.format(f"M]]{k}")
            got, (qualified, bare) = estate.traits_of(text), references(text)
            want = scoring.analyse(text)
            assert {c: got[c] for c in want} == want
            assert [(r["table"], r["name"]) for r in got["refs"]] == qualified + [(None, n) for n in bare]
    assert len(calls) <= len(forms)


def test_a_row_is_scored_once(spark):
    """Deductions and caps are columns: none is worked out again for each reason that names it."""
    rows = spark.createDataFrame([("m", "T", "a", ["FOO", "IF", "RANKX", "SUM"], ["boolean"], True, False, False, True, [], [])], scoring.SCHEMA)
    none = spark.createDataFrame([], "model string, from_table string, to_table string, cardinality string, cross_filter string, is_active boolean")
    done = scoring.scored(rows, none)
    [r] = done.collect()
    assert (r.own_score, r.reasons) == (3, ["-12: pattern rewrites", "-15: filtered aggregate", "-10: variables", "-30: ranking", "-30: unknown functions"])
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOOKUPVALUE") == 2  # among the known names and as what a lookup takes off


def test_keys_of_many_rows_in_nested_rows(spark, monkeypatch):
    """Keys that are cut in parts, all or some or none, give the same; columns over the same nested rows share one window."""
    rng = random.Random(6)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([*range(30), None]), rng.choice([1.5, 2.5, None])) for i in range(300)]
    rows = spark.createDataFrame(data, "id int, k string, x int, v double")
    view = MetricView(SemanticModel("m", (Table("T", None, tuple(Column(c, "int64") for c in ("id", "k", "x", "v"))),)), "T", lambda t: rows)
    ops = {"<": lambda a, b: a < b, ">=": lambda a, b: a >= b}
    for op, test in ops.items():
        for key in ("T[k] = EARLIER(T[k]) && ", ""):
            over = f"FILTER(T, {key}T[x] {op} EARLIER(T[x] + 5) && T[id] < 250)"
            for many in (0, 200, 1000):
                monkeypatch.setattr(rowcontext, "MANY", many)
                out = rowcontext.calculated(view, "T", {"n": f"COUNTROWS({over})", "s": f"SUMX({over}, T[v])", "hi": f"MAXX({over}, T[id])"})
                got = out.collect()
                assert len(got) == len(data)
                for r in got:
                    seen = [d for d in data if d[2] is not None and r.t__x is not None and (not key or d[1] is not None and d[1] == r.t__k) and test(d[2], r.t__x + 5) and d[0] < 250]
                    full = [d[3] for d in seen if d[3] is not None]
                    assert (r.n, r.s, r.hi) == (len(seen), sum(full) if full else None, max((d[0] for d in seen), default=None))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1


def test_tables_behind_are_joined_first(spark):
    """The same rows, the fact's joined with its own neighbours alone."""
    view = samples.view(spark, SF)
    inward, plain = view.frame({"region", "part"}, inward=True), view.frame({"region", "part"})
    assert inward.select(plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(inward.select(plain.columns)).isEmpty()
    assert inward.count() == plain.count()
