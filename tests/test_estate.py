"""Lineage without all pairs, models in frames, stored aggregates."""

import random

import pytest

from starweave import queries, samples
from starweave.model import frames
from starweave.operators import estate, lineage, scoring
from starweave.plans import stored
from starweave.plans.dax import DaxError

SF = "/root/testdata/sf0.001"


def reached(edges):
    out = {}
    for start in {x for e in edges for x in e}:
        seen = {d for s, d in edges if s == start}
        while more := {d for s, d in edges if s in seen} - seen:
            seen |= more
        out[start] = seen
    return out


def test_levels_and_cycles_by_hand(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(19)} | {(30, 31), (31, 30), (31, 32), (40, 40), (41, 40)}
    reach = reached(edges)
    of = {n: frozenset({m for m in reach[n] if n in reach[m]} | {n}) for n in reach}
    knots = {n: of[n] for n in reach if n in reach[n]}

    def depth(c):
        return len(c) - 1 + max([0, *[1 + depth(of[d]) for s, d in edges if s in c and d not in c]])

    want = {(n, min(knots[n]) if n in knots else None, len(of[n]), depth(of[n]), min([100 - n, *[100 - m for m in reach[n]]])) for n in reach}
    rows = spark.createDataFrame([*edges, (None, 1), (2, None)], "src int, dst int")
    values = spark.createDataFrame([(n, 100 - n) for n in reach], "node int, value int")
    assert {tuple(r) for r in lineage.levels(rows, values).collect()} == want
    assert {(r.component, tuple(r.members)) for r in lineage.cycles(rows).collect()} == {(min(c), tuple(sorted(c))) for c in knots.values()}
    none = spark.createDataFrame([], "src int, dst int")
    assert lineage.levels(none).count() == lineage.components(none).count() == 0


def test_an_estate_scores_as_models_do(spark):
    models = [queries.finance(), samples.model()]
    e = frames(spark, *models)
    done = estate.classify(estate.Estate(e["tables"], e["columns"], e["measures"], e["relationships"]))
    names = ["model", "name", "score", "band", "bucket", "category", "depth", "cyclic"]
    got, want = ({tuple(r) for r in x.select(*names).collect()} for x in (done, scoring.classify(spark, *models)))
    assert got == want
    refs = estate.references_of(estate.Estate(e["tables"], e["columns"], e["measures"], e["relationships"]), estate.traits(e["measures"]))
    edges, gaps = scoring.resolved(spark, *models)
    assert {tuple(r) for r in refs.where("kind is not null").select("model", "measure", "kind", "target").collect()} == {tuple(r) for r in edges.collect()}
    assert {tuple(r) for r in refs.where("kind is null").select("model", "measure", "reference", "reason").collect()} == {(r.model, r.object_ref.split(":", 1)[1], r.reference, r.reason) for r in gaps.where("object_ref like 'Measure%'").collect()}


def test_an_estate_takes_nulls_and_texts_that_do_not_parse(spark):
    measures = spark.createDataFrame([("m", "T", "a", None), ("m", "T", "b", "SUM((("), ("m", "T", "c", "[B] + [x] ?? 1"), (None, "T", "d", "1"), ("m", None, "e", "[A]")], "model string, table string, name string, expression string")
    tables = spark.createDataFrame([("m", "T")], "model string, name string")
    columns = spark.createDataFrame([("m", "T", "x")], "model string, table string, name string")
    none = spark.createDataFrame([], "model string, from_table string, to_table string, cardinality string, cross_filter string, is_active boolean")
    done = estate.classify(estate.Estate(tables, columns, measures, none)).collect()
    assert sorted(r.name for r in done) == ["a", "b", "c", "e"]
    assert estate.classify(estate.Estate(tables, columns, measures.limit(0), none)).count() == 0


def rounded(rows):
    return sorted([tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows.collect()], key=str)


CASES = [
    (["Region"], ["Total Revenue", "Average Discount", "Lines"], None), (["Region", "Order Year"], ["Revenue YoY", "Share of Regions", "Revenue YTD", "Suppliers"], None),
    (["Order Month"], ["Returned Revenue", "Revenue to Now"], 'lineitem[l_returnflag] <> "N"'), (["Order Month"], ["Suppliers", "Revenue Rolling 3M"], None), ([], ["Suppliers"], None), (["Region"], ["Suppliers YTD", "Suppliers Everywhere"], None),
]


def test_stored_aggregates_answer_alone(spark, tmp_path):
    view = samples.view(spark, SF)
    stored.store(view, f"{tmp_path}/a", *queries.STORED, by="Date[Date]")
    stored.store(view, f"{tmp_path}/b", ["region[r_name]"], ["Total Revenue"])
    small, large = stored.opened(spark, f"{tmp_path}/b", "lineitem"), stored.opened(spark, f"{tmp_path}/a", "lineitem")
    fast = samples.view(spark, SF).with_stored(large, small)
    for dims, measures, where in CASES:
        got = fast.query(dims, measures, where)
        assert not [f for f in got.inputFiles() if "testdata" in f], measures
        assert rounded(got) == rounded(view.query(dims, measures, where)), measures
    assert all("/b/" in f for f in fast.query(["Region"], ["Total Revenue"]).inputFiles())
    # what isn't stored is read from the facts
    for dims, measures, where in [(["Brand"], ["Total Revenue"], None), (["Region"], ["Quantity"], None), (["Region"], ["Open Revenue"], None), (["Region"], ["Total Revenue"], "lineitem[l_quantity] > 10")]:
        got = fast.query(dims, measures, where)
        assert [f for f in got.inputFiles() if "lineitem" in f] and rounded(got) == rounded(view.query(dims, measures, where))
    based = samples.view(spark, SF, base_filter='region[r_name] = "ASIA"')
    want = rounded(based.query(["Order Year"], ["Total Revenue"]))
    assert rounded(based.with_stored(large).query(["Order Year"], ["Total Revenue"])) == want


def test_a_refresh_drops_months_that_are_empty_now(spark, tmp_path):
    view = samples.view(spark, SF)
    stored.store(view, f"{tmp_path}/a", *queries.STORED, by="orders[order_date]")
    less = samples.view(spark, SF)
    source = less.source
    gone = source(view.model.table("orders")).where("year(o_orderdate) = 1995")
    gone_keys = gone.select(gone["o_orderkey"].alias("l_orderkey"))
    less.source = lambda t: source(t).join(gone_keys, "l_orderkey", "left_anti") if t.name == "lineitem" else source(t)
    stored.refresh(less, f"{tmp_path}/a", *queries.STORED, by="orders[order_date]", changed=gone.selectExpr("to_date(o_orderdate)"))
    fast = samples.view(spark, SF).with_stored(stored.opened(spark, f"{tmp_path}/a", "lineitem"))
    want = rounded(less.query(["Order Year"], ["Total Revenue", "Lines", "Suppliers"]))
    assert rounded(fast.query(["Order Year"], ["Total Revenue", "Lines", "Suppliers"])) == want


def test_only_left_joins_are_stored(spark, tmp_path):
    with pytest.raises(DaxError):
        stored.store(samples.view(spark, SF, join="inner"), f"{tmp_path}/a", *queries.STORED)


def test_nested_row_contexts_by_hand(spark):
    from starweave.model import Column, SemanticModel, Table
    from starweave.plans.metricview import MetricView
    from starweave.plans.rowcontext import calculated

    rng = random.Random(5)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, None]), rng.choice([1.5, 2.5, None])) for i in range(40)]
    rows = spark.createDataFrame(data, "id int, k string, x int, v double")
    view = MetricView(SemanticModel("m", (Table("T", None, tuple(Column(c, "int64") for c in ("id", "k", "x", "v"))),)), "T", lambda t: rows)
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    for op, test in ops.items():
        over = f"FILTER(T, T[k] = EARLIER(T[k]) && T[x] {op} EARLIER(T[x]) && T[id] < 35)"
        out = calculated(view, "T", {"n": f"COUNTROWS({over}) * 2", "s": f"SUMX({over}, T[v])", "a": f"AVERAGEX({over}, T[v])", "lo": f"MINX({over}, T[v])"})
        assert "CartesianProduct" not in out._jdf.queryExecution().toString()
        for r in out.collect():
            seen = [d[3] for d in data if None not in (d[1], d[2], r.t__k, r.t__x) and d[1] == r.t__k and test(d[2], r.t__x) and d[0] < 35]
            full = [v for v in seen if v is not None]
            assert (r.n, r.s, r.lo) == (2 * len(seen), sum(full) if full else None, min(full, default=None))
            assert r.a == (pytest.approx(sum(full) / len(full)) if full else None)
    for bad in ("EARLIER(T[x])", "COUNTROWS(FILTER(T, T[x] + EARLIER(T[x]) > 3))", "COUNTROWS(FILTER(T, T[x] < EARLIER(T[x]) && T[v] < EARLIER(T[v])))", "COUNTROWS(FILTER(T, T[x] <> EARLIER(T[x])))"):
        with pytest.raises(DaxError):
            calculated(view, "T", {"c": bad})
