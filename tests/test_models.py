import json

import pytest
from pyspark.sql import functions as F

from starweave import model, samples
from starweave.operators import catalog, scoring
from starweave.operators import review
from starweave.operators.review import lint, translation_risks
from starweave.sources import models, store

TMDL = """createOrReplace

\tmodel Shop
\t\ttable Sales
\t\t\tcolumn Key
\t\t\t\tdataType: int64
\t\t\t\tisHidden
\t\t\tcolumn Amount
\t\t\t\tdataType: decimal
\t\t\tcolumn Double = [Amount] * 2
\t\t\t\tdataType: decimal
\t\t\tmeasure 'It''s Total' = SUM(Sales[Amount])
\t\t\t\tformatString: 0
\t\t\tmeasure Text = ```
\t\t\t\t\t"a" & [It's Total]
\t\t\t\t\t```
\t\t\tmeasure Long =
\t\t\t\t\tVAR x = SUM(Sales[Amount])
\t\t\t\t\tRETURN x
\t\t\t\tformatString: 0
\t\t\tmeasure Empty
\t\t\tpartition Sales = m
\t\t\t\tmode: import
\t\t\t\tsource =
\t\t\t\t\tlet Source = Teradata.Database(#"Server", [H=true]),
\t\t\t\t\tS = Source{[Schema="EDW"]}[Data],
\t\t\t\t\tV = S{[Name="V_SALES"]}[Data] in V
\t\ttable LocalDate
\t\t\tcolumn Date
\t\t\t\tdataType: dateTime
\t\t\tannotation __PBI_LocalDateTable = true
\t\trelationship r1
\t\t\tfromColumn: Sales.Key
\t\t\ttoColumn: 'LocalDate'.Date
\t\t\tcrossFilteringBehavior: bothDirections
\t\t\tisActive: false
\t\texpression Server = "td.example.com" meta [IsParameterQuery=true, Type="Text"]
"""
JSON = {
    "model": {
        "tables": [
            {"name": "Fact", "columns": [{"name": "K", "dataType": "int64"}, {"name": "V", "dataType": "double"}, {"name": "C", "expression": ["[V]", "* 2"]}, {}], "measures": [{"name": "M", "expression": ["SUM(", "Fact[V])"]}, {"name": "None"}],
             "hierarchies": [{"name": "H", "levels": [{"name": "b", "ordinal": 1, "column": "V"}, {"name": "a", "ordinal": 0, "column": "K"}]}]},
            {"name": "Dim", "columns": [{"name": "K", "dataType": "int64"}], "source": "EDW.DIM"},
        ],
        "relationships": [{"fromTable": "Fact", "fromColumn": "K", "toTable": "Dim", "toColumn": "K", "toCardinality": "many"}],
        "roles": [{"name": "r", "tablePermissions": [{"name": "Dim"}]}],
    }
}


def test_text_form():
    m = models.load(TMDL)
    sales = m.table("sales")
    assert m.name == "Shop"
    assert [c.name for c in sales.columns] == ["Key", "Amount", "Double"]
    assert (sales.columns[0].hidden, sales.columns[2].expression) == (True, "[Amount] * 2")
    assert {x.name: x.expression for x in sales.measures} == {"It's Total": "SUM(Sales[Amount])", "Text": '"a" & [It\'s Total]', "Long": "VAR x = SUM(Sales[Amount])\nRETURN x", "Empty": ""}
    assert sales.measures[3].status == model.REQUIRES_INPUT
    assert sales.source_hint == "Teradata: td.example.com.EDW.V_SALES"
    assert m.table("LocalDate").display_name == "Date table for Sales.Key"
    assert m.relationships == (model.Relationship("Sales", "Key", "LocalDate", "Date", "MANY_TO_ONE", "BOTH", False),)


def test_json_form():
    m = models.load(json.dumps(JSON), "j")
    fact = m.table("Fact")
    assert [c.name for c in fact.columns] == ["K", "V", "C", "UnnamedColumn3"]
    assert fact.measures[0].expression == "SUM(\nFact[V])"
    assert fact.measures[1].status == model.REQUIRES_INPUT
    assert fact.hierarchies == (("H", ("K", "V")),)
    assert m.relationships[0].cardinality == "MANY_TO_MANY"
    assert m.features["rls_filters"] == 1
    assert models.from_json(json.dumps({"createOrReplace": {"database": JSON}})).tables


@pytest.mark.parametrize(
    ("text", "shape"),
    [(TMDL, models.TMDL_MODEL), (json.dumps(JSON), models.POWER_BI_MODEL), ('{"platform": "Teradata", "objects": []}', models.TERADATA_EXPORT), ('{"platform": "databricks"}', models.DATABRICKS_EXPORT), ("[1]", models.UNKNOWN), ('{"a": 1}', models.UNKNOWN)],
)
def test_detection(spark, text, shape):
    assert models.detect(text) == shape
    assert spark.createDataFrame([(text,)], "t string").select(models.detected(F.col("t"))).first()[0] == shape


def test_broken_files_are_named(spark):
    with pytest.raises(models.InvalidModel):
        models.detect("{nope")
    with pytest.raises(models.InvalidModel):
        models.load('{"a": 1}')


def test_discovery_and_store(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "m.bim").write_text(json.dumps(JSON))
    (tmp_path / "in" / "s.tmdl").write_text(TMDL)
    (tmp_path / "in" / "x.pbix").write_bytes(b"\0")
    rows = {r.path.rsplit("/", 1)[1]: (r.shape, r.skipped) for r in models.discover(spark, f"{tmp_path}/in").collect()}
    assert rows["m.bim"] == (models.POWER_BI_MODEL, None)
    assert rows["x.pbix"][1]
    found = models.load_folder(spark, f"{tmp_path}/in")
    assert len(found) == 2
    s = store.ProjectStore(spark, f"{tmp_path}/projects")
    s.save("p", *found)
    s.save("p", *found)
    s.save("q", found[0])
    assert s.get("p")["tables"].count() == 4
    assert {r.project_id for r in s.projects().collect()} == {"p", "q"}
    again = s.load("q")[0]
    assert again.relationships == found[0].relationships
    assert [m.name for t in again.tables for m in t.measures] == ["M", "None"]
    s.delete("p")
    assert [r.project_id for r in s.projects().collect()] == ["q"]


def test_validation_and_frames(spark):
    t = model.Table("T", columns=(model.Column("a"),), measures=(model.Measure("m", ""), model.Measure("M", "1")))
    fatal, warn = model.validate(model.SemanticModel("x", (t, model.Table("t"), model.Table("u")), (model.Relationship("T", "a", "Z", "b"),)))
    assert len(fatal) == 3
    assert len(warn) == 3
    assert model.frames(spark, samples.model())["measures"].count() == len(samples.model().measures())


def test_yaml_round_trip(spark):
    v = samples.view(spark, "/root/testdata/sf0.001")
    text = store.view_yaml(v)
    import yaml

    body = yaml.safe_load(text)
    assert {j["name"] for j in body["joins"]} >= {"orders", "customer", "supplier_nation", "date"}
    assert all("-- DAX:" in m["expr"] for m in body["measures"])
    fresh = samples.view(spark, "/root/testdata/sf0.001")
    fresh.measures_by_name = {}
    back = store.view_from_yaml(text, fresh)
    assert back.query(["r_name"], ["total revenue"]).count() == 5
    assert lint(spark, body).where("severity = 'CRITICAL'").count() == 0
    assert "USING PARQUET" in store.table_ddl(samples.model().table("orders"))
    assert store.view_ddl("v", v).startswith("CREATE OR REPLACE VIEW v WITH METRICS")
    pack = store.query_pack(v, ["Lines"], [[], ["Region"]])
    assert pack["Lines|total"].first()[0] == pack["Lines|Region"].agg(F.sum("Lines")).first()[0]


def test_lint_finds_what_is_wrong(spark):
    spec = {"version": "0.9", "source": "s", "joins": [{"name": "d", "on": "cast(a as int) = b"}], "dimensions": [{"name": "x"}, {"name": "x"}], "measures": [{"name": "m", "expr": "sum(a) / sum(b)"}, {"name": "w", "expr": "sum(x) OVER () -- TODO -- DAX: CALCULATE(SUM(T[x]), T[y] = 1)"}]}
    rows = {(r.finding, r.object) for r in lint(spark, spec, {"a"}, {"m": "MANUAL_PORT"}, {"m": False}, {"roles": 1}).collect()}
    assert rows == {("A1", "spec"), ("A4", "d"), ("A6", "x"), ("B1", "m"), ("B3", "m"), ("B11", "m"), ("B2", "w"), ("B5", "w"), ("B9", "w"), ("G3", "m"), ("C2", "m"), ("C4", "roles")}
    assert translation_risks("INT(1) + MIN(1, 2) + MAX(T[a])") == ["INT: truncates or floors", "MIN: two arguments"]


@pytest.mark.parametrize(
    ("dax", "score", "band", "category"),
    [
        ("SUM(Fact[V])", 100, "AUTO", "A"), ("CALCULATE([X], Fact[V] > 1)", 85, "AUTO_SPOT_CHECK", "D"), ("SUMX(Fact, Fact[V])", 88, "AUTO_SPOT_CHECK", "B"), ("TOTALYTD([X], Dim[K])", 35, "MANUAL_PORT", "C"),
        ("USERNAME()", 10, "UNSUPPORTED", "F"), ("LASTNONBLANK(Dim[K], [X])", 35, "MANUAL_PORT", "E"), ("SUMX(FILTER(Fact, Fact[V] > 1), Fact[V])", 53, "NEEDS_REVIEW", "B"), ("CALCULATE([X], ALL(Fact))", 55, "NEEDS_REVIEW", "D"),
        ("FOO(1) + BAR(2) + BAZ(3)", 40, "NEEDS_REVIEW", "A"), ("VAR x = [X] RETURN IF(x = BLANK(), 0, x)", 68, "NEEDS_REVIEW", "B"), ("CALCULATE([X], USERELATIONSHIP(Fact[K], Dim[K]))", 30, "MANUAL_PORT", "D"), ("TREATAS(VALUES(Dim[K]), Fact[K])", 25, "MANUAL_PORT", "B"),
    ],
)
def test_scores(spark, dax, score, band, category):
    t = model.Table("Fact", None, (model.Column("K"), model.Column("V")), (model.Measure("X", "SUM(Fact[V])"), model.Measure("Y", dax)))
    m = model.SemanticModel("m", (t, model.Table("Dim", None, (model.Column("K"),))), (model.Relationship("Fact", "K", "Dim", "K"),))
    r = scoring.classify(spark, m).where("name = 'Y'").first()
    assert (r.score, r.band, r.category) == (score, band, category)


def test_two_directions_and_weak_links(spark):
    t = model.Table("Fact", None, (model.Column("K"), model.Column("V")), (model.Measure("X", "SUM(Fact[V])"), model.Measure("Y", "[X] + 1"), model.Measure("Amb", "[K]"), model.Measure("Case", "[x]")))
    m = model.SemanticModel("m", (t, model.Table("Dim", None, (model.Column("K"), model.Column("D")))), (model.Relationship("Fact", "K", "Dim", "K", cross_filter="BOTH"),))
    assert {r.score for r in scoring.classify(spark, m).collect()} == {45}
    edges, gaps = scoring.resolve(m)
    assert ("Case", "MEASURE", "X") in edges
    assert ("Amb", "COLUMN", "Fact[K]") in edges
    assert not gaps
    assert catalog.gap_inventory(spark, m).first().reason.startswith("bidirectional")


def test_lineage_walks(spark):
    nodes, edges = catalog.lineage(spark, samples.model())
    ids = {r.label: r.id for r in nodes.collect()}
    up = {r.id for r in catalog.reachable(edges, ids["Revenue YoY Pct"]).collect()}
    assert {ids["Revenue YoY"], ids["Total Revenue"], ids["lineitem[l_extendedprice]"]} <= up
    down = {r.id for r in catalog.reachable(edges, ids["lineitem[l_extendedprice]"], "upstream").collect()}
    assert ids["Revenue YoY Pct"] in down
    kept, inner = catalog.visible(nodes, edges, tables_only=True)
    assert kept.where("kind = 'MEASURE'").count() == 0
    assert inner.join(nodes.where("kind = 'COLUMN'"), inner["dst"] == nodes["id"]).count() == 0
    assert catalog.search(nodes, "YOY").count() == 2
    assert catalog.snapshot(nodes, edges).first().graph.startswith('{"nodes"')


def test_reports(spark):
    m = samples.model()
    one = catalog.dashboard(spark, m).first()
    assert (one.tables, one.measures) == (len(m.tables), len(m.measures()))
    assert {r.section for r in catalog.report(spark, m).collect()} >= {"tables", "measures", "facts", "gaps"}
    assert catalog.relationship_inventory(model.frames(spark, m)).count() == len(m.relationships)
    assert catalog.measure_inventory(spark, m).count() == len(m.measures())
    assert catalog.phase_plan(spark, m).count() == 9
    rows = scoring.classify(spark, m)
    assert 0 < catalog.model_score(rows).first().model_score <= 100
    names = {r.name for r in catalog.shared_tables(model.frames(spark, m, model.SemanticModel("other", (model.Table("Orders"),)))).collect()}
    assert names == {"orders"}


def test_layered_graphs_and_cycles(spark):
    """More ways than rows: a graph of layers, and a cycle with nodes above and below it."""
    layers = [(f"n{k}_{a}", f"n{k + 1}_{b}") for k in range(14) for a in range(3) for b in range(3)]
    edges = spark.createDataFrame([*layers, ("top", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "leaf"), ("It's", "top")], "src string, dst string")
    assert len(layers) == 126
    reach = scoring.closure(edges)
    found = {(r.src, r.dst): r.steps for r in reach.collect()}
    assert found["n0_0", "n14_2"] == 14
    assert found["x", "x"] == 3
    depth = {r.node: r.depth for r in scoring.depths(edges, reach).collect()}
    assert (depth["n0_1"], depth["n14_0"], depth["leaf"], depth["x"], depth["y"], depth["top"], depth["It's"]) == (14, 0, 0, 3, 3, 4, 5)
    assert {r.id: r.distance for r in catalog.reachable(edges, "It's").collect()} == {"It's": 0, "top": 1, "x": 2, "y": 3, "z": 4, "leaf": 5}
    assert {r.id for r in catalog.reachable(edges, "top", "both").collect()} == {"It's", "top", "x", "y", "z", "leaf"}


def test_lint_of_outside_evidence(spark):
    spec = {"version": "1.1", "source": "s", "joins": [{"name": "d", "source": "c.s.dim", "on": "a = b"}], "measures": []}
    rules = lambda e: {(r.finding, r.severity, r.object) for r in lint(spark, spec, evidence=e).collect()}
    assert rules(None) == set()
    assert rules({}) == {("A5", "CRITICAL", "joins"), ("A8", "HIGH", "view"), ("A9", "CRITICAL", "profile")}
    good = {"joined": {"Dim": "c.s.dim"}, "grain": {"d": 0}, "syntax": True, "profile": {"Dim": "c.s.dim"}, "scanned": True}
    assert rules(good) == set()
    assert rules(good | {"joined": {"Dim": "c.s.other"}, "grain": {"d": 7}, "profile": {"Dim": None}, "scanned": False}) == {("A2", "MEDIUM", "Dim"), ("A5", "HIGH", "d"), ("A9", "CRITICAL", "Dim"), ("A9", "HIGH", "profile")}


def test_risks_of_translations(spark):
    rows = [("ok", "SUM(T[a])", "sum(a)"), ("left", "CALCULATE(SUM(T[a]))", "CALCULATE(sum([a]))"), ("and", 'T[a] = "x && y" && T[b]', "a = 'x && y' && b"), ("or", "a || b", "a || b"), ("join", "a & b", "a || b"), ("bit", "a & b", "a & b"), ("int", "INT(a)", "int(a)"), ("two", "MIN(a, b)", "min(a, b)")]
    found = {}
    for r in review.sql_risks(spark, spark.createDataFrame(rows, "name string, dax string, sql string")).collect():
        found.setdefault(r.name, set()).add(r.risk)
    assert found == {"left": {"dax_residue"}, "and": {"operator"}, "or": {"operator"}, "bit": {"operator"}, "int": {"meaning"}, "two": {"meaning"}}


def test_gaps_of_another_tool(spark):
    t = model.Table("F", None, (model.Column("V"),), (model.Measure("S", "SUM(F[V]) // [Comment]"), model.Measure("A", "[s] + D[S] + [K] + [Nope] + F[None]"), model.Measure("B", 'SUMX(ADDCOLUMNS(D, "n", 1), [n])')))
    m = model.SemanticModel("m", (t, model.Table("D", None, (model.Column("K"),))))
    told = [("S", "[Comment]"), ("A", "[s]"), ("A", "D[S]"), ("A", "[K]"), ("A", "[Nope]"), ("A", "F[None]"), ("B", "[n]")]
    got = scoring.classified_gaps(spark, m, spark.createDataFrame(told, "measure string, reference string")).collect()
    assert {r.reference: r.verdict for r in got} == {"[Comment]": "phantom", "[s]": "case", "D[S]": "qualified_measure", "[K]": "column_other_table", "[Nope]": "confirmed", "F[None]": "confirmed", "[n]": "virtual_column"}


def test_projects_templates_and_sources(spark, tmp_path):
    import io
    import zipfile

    for name in ("Shop", "Other"):
        d = tmp_path / f"{name}.SemanticModel" / "definition"
        (d / "tables").mkdir(parents=True)
        (d / "model.tmdl").write_text(f"model {name}\n")
        (d / "tables" / "T.tmdl").write_text(f"table {name}Table\n\tcolumn K\n\t\tdataType: int64\n")
        (d.parent / "model.bim").write_text('{"model": {"tables": []}}')
    (tmp_path / "x.Report").mkdir()
    (tmp_path / "x.Report" / "r.json").write_text("{}")
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("DataModelSchema", '{"name": "Templ", "model": {"tables": [{"name": "P"}]}}'.encode("utf-16-le"))
    (tmp_path / "t.pbit").write_bytes(body.getvalue())
    rows = models.discover(spark, str(tmp_path)).collect()
    assert sorted(r.kind for r in rows if r.skipped is None) == ["pbit"] + ["project"] * 4
    assert {r.path.rsplit("/", 1)[1] for r in rows if r.skipped} == {"model.bim", "r.json"}
    assert sorted((m.name, [t.name for t in m.tables]) for m in models.load_folder(spark, str(tmp_path))) == [("Other", ["OtherTable"]), ("Shop", ["ShopTable"]), ("Templ", ["P"])]
    queries = [("a", 'Teradata.Database("td.example.com"), x{[Schema="S"]}, y{[Name="N"]}'), ("b", 'Teradata.Database(#"Host Name", [H=true])[Item="I"]'), ("c", "Teradata.Database(Server)"), ("d", "Sql.Database(1)"), ("e", "Teradata.Database(Unknown)")]
    values = {"Host Name": "host", "Server": "srv"}
    want = {"a": "Teradata: td.example.com.S.N", "b": "Teradata: host.I", "c": "Teradata: srv", "e": "Teradata: Unknown"}
    assert {t: h for t, q in queries if (h := models.source_hint(q, values))} == want
    frame = models.source_hints(spark.createDataFrame(queries, "table string, query string"), spark.createDataFrame(list(values.items()), "name string, value string"))
    assert {r.table: r.hint for r in frame.collect()} == want
    kinds = spark.createDataFrame([("Folder.Files(1) SharePoint.Tables()",), ("nothing",)], "q string").select(models.source_kinds(F.col("q")).alias("k")).collect()
    assert [r.k for r in kinds] == [["Folder", "SharePoint"], [models.NO_SOURCE]]


def test_plan_counts_what_is_open(spark):
    plan = {r.key: r for r in catalog.phase_plan(spark, samples.model()).collect()}
    assert plan["discovery"].status == "CONFIRMED"
    assert plan["gold"].status == "REQUIRES_INPUT"
    assert plan["gold"].blocked
    assert len(plan["validation"]["items"]) == len(samples.model().measures())
    assert catalog.phase_plan(spark).where("status = 'CONFIRMED'").count() == 0
