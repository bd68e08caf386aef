"""How far a measure can be translated automatically: analysis, score, band, category; facts and dimensions of a model.

Expressions are parsed on the driver into one row of rule hits each; scores, bands, propagation along dependencies and
histograms are DataFrame expressions over these rows.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave.model import SemanticModel
from starweave.plans.dax import Bin, Call, DaxError, Lit, Ref, TableRef, functions_used, parse, references, tokens, walk

# The classes of function names that scoring distinguishes.
DIRECT = [
    "SUM", "AVERAGE", "MIN", "MAX", "COUNTROWS", "COUNT", "COUNTA", "DISTINCTCOUNT", "DISTINCTCOUNTNOBLANK", "DIVIDE", "BLANK", "ABS", "ROUND", "INT",
    "MOD", "SQRT", "EXP", "LN", "LOG", "POWER", "CONCATENATE", "LEFT", "RIGHT", "MID", "LEN", "UPPER", "LOWER", "TRIM", "SUBSTITUTE", "SEARCH",
    "FIND", "YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "WEEKDAY", "EOMONTH", "TODAY", "NOW", "FORMAT", "TRUE", "FALSE", "AND", "OR", "NOT",
]
REWRITTEN = [
    "IF", "SWITCH", "ISBLANK", "COALESCE", "SELECTEDVALUE", "COUNTBLANK", "SUMX", "AVERAGEX", "MINX", "MAXX", "COUNTX", "VALUES", "HASONEVALUE",
    "CALCULATE",
]
TIME = [
    "SAMEPERIODLASTYEAR", "DATESYTD", "DATESQTD", "DATESMTD", "DATEADD", "PARALLELPERIOD", "TOTALYTD", "TOTALQTD", "TOTALMTD", "DATESINPERIOD",
    "DATESBETWEEN", "PREVIOUSMONTH", "PREVIOUSQUARTER", "PREVIOUSYEAR", "PREVIOUSDAY", "NEXTMONTH", "NEXTQUARTER", "NEXTYEAR", "NEXTDAY", "FIRSTDATE",
    "LASTDATE", "STARTOFMONTH", "STARTOFQUARTER", "STARTOFYEAR", "ENDOFMONTH", "ENDOFQUARTER", "ENDOFYEAR",
]
SEMI_ADDITIVE = [
    "LASTNONBLANK", "LASTNONBLANKVALUE", "FIRSTNONBLANK", "FIRSTNONBLANKVALUE", "OPENINGBALANCEMONTH", "OPENINGBALANCEQUARTER", "OPENINGBALANCEYEAR",
    "CLOSINGBALANCEMONTH", "CLOSINGBALANCEQUARTER", "CLOSINGBALANCEYEAR",
]
VIRTUAL, SECURITY, RANKING, NESTED = ["TREATAS", "CROSSFILTER"], ["USERNAME", "USERPRINCIPALNAME", "CUSTOMDATA"], ["RANKX", "TOPN"], ["EARLIER", "EARLIEST"]
ALL_FAMILY = ["ALL", "ALLEXCEPT", "REMOVEFILTERS", "ALLSELECTED"]
OTHERS = [
    "KEEPFILTERS", "FILTER", "RELATED", "RELATEDTABLE", "LOOKUPVALUE", "VAR", "RETURN", "ADDCOLUMNS", "SUMMARIZE", "SUMMARIZECOLUMNS", "CROSSJOIN",
    "GENERATE", "DISTINCT", "CONCATENATEX", "ISFILTERED", "ISCROSSFILTERED", "SELECTEDMEASURE", "IN", "USERELATIONSHIP",
]
KNOWN = [*DIRECT, *REWRITTEN, *TIME, *SEMI_ADDITIVE, *VIRTUAL, *SECURITY, *RANKING, *NESTED, *ALL_FAMILY, *OTHERS]
VIRTUAL_TABLES = ["FILTER", "VALUES", "ALL", "ADDCOLUMNS", "SUMMARIZE", "CROSSJOIN", "GENERATE", "TOPN", "DISTINCT"]
ITERATORS = ["SUMX", "AVERAGEX", "MINX", "MAXX", "COUNTX", "CONCATENATEX", "RANKX"]
BANDS = ((90, "AUTO"), (70, "AUTO_SPOT_CHECK"), (40, "NEEDS_REVIEW"), (11, "MANUAL_PORT"), (0, "UNSUPPORTED"))


def filter_kind(arg) -> str:
    """The kind of one filter argument of CALCULATE."""
    if isinstance(arg, Call):
        kinds = {"ALL": "all_family", "ALLEXCEPT": "all_family", "REMOVEFILTERS": "all_family", "KEEPFILTERS": "keepfilters", "USERELATIONSHIP": "relationship", "CROSSFILTER": "relationship", "TREATAS": "relationship", "FILTER": "filter_table"}
        return kinds.get(arg.name, "other")
    return "boolean" if isinstance(arg, Bin) and arg.op in ("=", "<>", "<", "<=", ">", ">=", "IN", "&&", "||") else "other"


def analyse(expression: str) -> dict:
    """Functions, filter kinds and traits of an expression; what doesn't parse has its functions only."""
    found = tokens(expression)
    try:
        tree = parse(expression, found)
    except DaxError:
        tree = None
    return analysis(expression, found, tree)


def analysis(expression: str, found: list[tuple[str, str]], tree) -> dict:
    """As ``analyse``, of an expression that is read already: its tokens and tree (null: it doesn't parse)."""
    out = {"functions": sorted(functions_used(expression, found)), "filter_kinds": [], "uses_var": any(k == "name" and v.upper() == "VAR" for k, v in found), "virtual_iterator": False, "blank_sensitive": False, "parses": True}
    if tree is None:
        return out | {"parses": False}
    kinds: set[str] = set()
    for n in walk(tree):
        if isinstance(n, Call) and n.name in ("CALCULATE", "CALCULATETABLE"):
            kinds |= {filter_kind(a) for a in n.args[1:]}
        if isinstance(n, Call) and n.name in ITERATORS and n.args and isinstance(n.args[0], Call) and n.args[0].name in VIRTUAL_TABLES:
            out["virtual_iterator"] = True
        if isinstance(n, Bin) and n.op in ("=", "<>"):
            sides = (n.left, n.right)
            blank = any(isinstance(s, Call) and s.name in ("BLANK", "ISBLANK") for s in sides)
            zero = any(s == Lit(0) for s in sides) and "ISBLANK" in out["functions"]
            out["blank_sensitive"] |= blank or zero
    return out | {"filter_kinds": sorted(kinds)}


SCHEMA = "model string, table string, name string, functions array<string>, filter_kinds array<string>, uses_var boolean, virtual_iterator boolean, blank_sensitive boolean, parses boolean, measures array<string>, tables array<string>"


def analysed(spark: SparkSession, *models: SemanticModel) -> DataFrame:
    rows = []
    for model in models:
        known = model.measures()
        for t in model.tables:
            for m in t.measures:
                a = analyse(m.expression)
                qualified, bare = references(m.expression)
                used = [known[n.lower()][1].name for n in [*bare, *[c for q, c in qualified if not has_column(model, q, c)]] if n.lower() in known and n.lower() != m.name.lower()]
                tables = sorted({model.table(q).name for q, c in qualified if model.table(q) is not None})
                rows.append((model.name, t.name, m.name, a["functions"], a["filter_kinds"], a["uses_var"], a["virtual_iterator"], a["blank_sensitive"], a["parses"], list(dict.fromkeys(used)), tables))
    return spark.createDataFrame(rows, SCHEMA)


def has_column(model: SemanticModel, table: str, column: str) -> bool:
    t = model.table(table)
    return t is not None and any(c.name.lower() == column.lower() for c in t.columns)


def _uses(names: list[str]) -> Column:
    return F.arrays_overlap("functions", F.lit(names))


def scored(rows: DataFrame, relationships: DataFrame) -> DataFrame:
    """Adds own_score, reasons; relationship flags come from a join on the tables a measure touches."""
    flagged = relationships.where("is_active").select(
        "model", F.explode(F.array("from_table", "to_table")).alias("t"), (F.col("cross_filter") == "BOTH").alias("bidi"), (F.col("cardinality") == "MANY_TO_MANY").alias("m2m")
    ).groupBy("model", "t").agg(F.max("bidi").alias("bidi"), F.max("m2m").alias("m2m"))
    touched = rows.select("model", "name", F.explode(F.array_union("tables", F.array("table"))).alias("t")).join(flagged, ["model", "t"]).groupBy("model", "name").agg(F.max("bidi").alias("bidi"), F.max("m2m").alias("m2m"))
    rows = rows.join(touched, ["model", "name"], "left")
    kind = lambda k: F.array_contains("filter_kinds", k)
    # a row's names are distinct; isin looks them up in one set, array_except makes a set for each row
    n_rewritten = F.size(F.filter("functions", lambda f: f.isin([x for x in REWRITTEN if x != "CALCULATE"])))
    n_unknown = F.size(F.filter("functions", lambda f: ~f.isin(KNOWN)))
    # Deductions and caps with their reasons.
    deductions = [
        (F.least(12 * n_rewritten, F.lit(36)), "pattern rewrites"), (F.when(kind("boolean"), 15), "filtered aggregate"), (F.when(kind("filter_table"), 25), "FILTER over a table"),
        (F.when(kind("keepfilters"), 20), "KEEPFILTERS"), (F.when(kind("other"), 20), "filter argument that isn't recognised"), (F.when(F.col("uses_var"), 10), "variables"),
        (F.when(F.col("virtual_iterator"), 35), "iterator over a virtual table"), (F.when(_uses(RANKING), 30), "ranking"), (F.when(_uses(["LOOKUPVALUE"]), 25), "lookup needs a join"),
        (F.when(F.col("blank_sensitive"), 10), "blank against zero"), (F.least(30 * n_unknown, F.lit(60)), "unknown functions"),
    ]
    caps = [
        (_uses(SECURITY), 10, "row-level security"), (_uses(VIRTUAL), 25, "virtual relationship"), (_uses(NESTED), 25, "nested row context"), (_uses(["USERELATIONSHIP"]), 30, "another relationship"),
        (_uses(TIME), 35, "time intelligence"), (_uses(SEMI_ADDITIVE), 35, "semi-additive"), (F.coalesce(F.col("bidi"), F.lit(False)), 45, "bidirectional path"),
        (F.coalesce(F.col("m2m"), F.lit(False)), 45, "many-to-many path"), (kind("all_family") | _uses(ALL_FAMILY), 55, "ALL family"),
    ]
    # columns, so that a row's deductions and caps are worked out once and not for each place that names them
    given = rows.columns
    rows = rows.select("*", *[F.coalesce(d, F.lit(0)).alias(f"_minus{k}") for k, (d, _) in enumerate(deductions)], *[F.coalesce(c, F.lit(False)).alias(f"_cap{k}") for k, (c, _, _) in enumerate(caps)])
    less = [F.col(f"_minus{k}") for k in range(len(deductions))]
    base = F.greatest(F.lit(100) - reduce(lambda a, b: a + b, less), F.lit(0))
    cap = F.least(*[F.when(F.col(f"_cap{k}"), v).otherwise(100) for k, (_, v, _) in enumerate(caps)])
    rows = rows.withColumn("_base", base)
    texts = [F.when(d > 0, F.concat(F.lit("-"), d.cast("string"), F.lit(f": {why}"))) for d, (_, why) in zip(less, deductions, strict=True)]
    texts += [F.when(F.col(f"_cap{k}") & (F.col("_base") > v), F.lit(f"cap {v}: {why}")) for k, (_, v, why) in enumerate(caps)]
    return rows.select(*[F.col(f"`{c}`") for c in given], F.least("_base", cap).alias("own_score"), F.array_compact(F.array(*texts)).alias("reasons"))


def band(score: Column) -> Column:
    return reduce(lambda c, b: c.when(score >= b[0], b[1]), BANDS[1:], F.when(score >= BANDS[0][0], BANDS[0][1]))


def bucket(band_: Column) -> Column:
    return F.when(band_.isin("AUTO", "AUTO_SPOT_CHECK"), "LOW").when(band_ == "NEEDS_REVIEW", "MEDIUM").otherwise("HIGH")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, shared by all executors; where it names none, on a local master only, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="starweave-"))
    return context.getCheckpointDir()


def settled(rows: DataFrame, parts: int | None = 1) -> DataFrame:
    """The rows as a checkpoint: a loop's next round doesn't plan the rounds before it again."""
    shared_folder(rows.sparkSession)
    return (rows.coalesce(parts) if parts else rows).checkpoint()  # one part for a single model's metadata: thousands of edges at most


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, steps): all that a node reaches, and the shortest way there. A node on a cycle reaches itself.

    A round follows one edge from the pairs that the round before has found, and drops pairs that are known. So the number of rows
    is that of pairs, however many ways there are between them.
    """
    edges = settled(edges.select("src", "dst").distinct())
    found = front = edges.select("src", "dst", F.lit(1).alias("steps"))
    on = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        further = front.join(on, "dst").select("src", F.col("next").alias("dst"), (F.col("steps") + 1).alias("steps")).distinct()
        front = settled(further.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def depths(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(node, depth): the longest chain of edges below each node; leaves have none.

    The members of a cycle count as one chain of all of them, whichever of them is entered.
    """
    pairs = reach.select("src", "dst")
    both = pairs.join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    mates = both.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("mates"))
    chains = nodes.join(mates, "node", "left").select("node", F.coalesce("mates", F.array("node")).alias("mates"))
    chains = settled(chains)
    ends = chains.select("node", F.element_at("mates", 1).alias("first"), F.element_at("mates", -1).alias("last"))
    inner = chains.where(F.size("mates") > 1).select(F.explode(F.arrays_zip(F.slice("mates", F.lit(1), F.size("mates") - 1).alias("a"), F.slice("mates", F.lit(2), F.size("mates")).alias("b"))).alias("e"))
    inner = inner.select("e.a", "e.b").distinct()
    from_, to = ends.select(F.col("node").alias("src"), F.col("first").alias("sf"), F.col("last").alias("sl")), ends.select(F.col("node").alias("dst"), F.col("first").alias("df"))
    outer = edges.join(from_, "src").join(to, "dst").where("sf != df").select(F.col("sl").alias("a"), F.col("df").alias("b"))
    links = inner.unionByName(outer).distinct()
    # without cycles now; nodes that have a chain of each length, once for a length however many chains there are
    long = edges.sparkSession.sql(
        "WITH RECURSIVE r(at, depth) AS (SELECT DISTINCT a, 1 FROM {links} UNION ALL SELECT DISTINCT l.a, r.depth + 1 FROM r JOIN {links} l ON l.b = r.at) SELECT at AS first, max(depth) AS depth FROM r GROUP BY at", links=links
    )
    return ends.join(long, "first", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def category() -> Column:
    """Of scored rows that know whether they are cyclic."""
    return (
        F.when(_uses(SECURITY) | _uses(NESTED) | (F.col("score") < 11) | F.col("cyclic"), "F").when(_uses(SEMI_ADDITIVE), "E").when(_uses(TIME), "C").when(F.size("filter_kinds") > 0, "D")
        .when((F.size("measures") > 0) | _uses(REWRITTEN), "B").otherwise("A")
    )


def classify(spark: SparkSession, *models: SemanticModel) -> DataFrame:
    """One row for each measure: score after its dependencies', band, bucket, category, depth and reasons.

    A measure scores no more than what it refers to; members of a cycle score 20 at most.
    """
    from starweave.model import frames

    rows = scored(analysed(spark, *models), frames(spark, *models)["relationships"])
    key = F.concat_ws("\x1f", "model", "name")
    edges = rows.select(key.alias("src"), F.explode("measures").alias("m"), "model").select("src", F.concat_ws("\x1f", "model", "m").alias("dst"))
    reach = closure(edges)
    cycle = reach.where("src = dst").select(F.col("src").alias("key"), F.lit(True).alias("cyclic"))
    depth = depths(edges, reach).withColumnRenamed("node", "key")
    rows = rows.withColumn("key", key).join(cycle, "key", "left").join(depth, "key", "left")
    rows = rows.withColumn("own_score", F.when(F.col("cyclic"), F.least("own_score", F.lit(20))).otherwise(F.col("own_score")))
    least = reach.join(rows.select(F.col("key").alias("dst"), F.col("own_score").alias("s")), "dst").groupBy(F.col("src").alias("key")).agg(F.min("s").alias("below"))
    rows = rows.join(least, "key", "left").withColumn("score", F.least("own_score", "below"))
    b = band(F.col("score"))
    return rows.select("model", "table", "name", "score", b.alias("band"), bucket(b).alias("bucket"), category().alias("category"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "functions", "measures", "tables", "reasons")


# --- references and gaps


def resolve(model: SemanticModel) -> tuple[list[tuple], list[tuple]]:
    """Edges (measure, kind, target) and gaps (measure, reference, why) of all references.

    A bare name is another measure, else a column of the home table, else the only column of that name. A qualified one is
    a column of its table, else a measure that lives there.
    """
    edges, gaps, known = [], [], model.measures()
    for t in model.tables:
        for m in t.measures:
            qualified, bare = references(m.expression)
            try:
                iterated = {n.args[0].name.lower() for n in walk(parse(m.expression)) if isinstance(n, Call) and n.args and isinstance(n.args[0], TableRef)}
            except DaxError:
                iterated = set()
            for name in bare:
                owners = [x.name for x in model.tables if has_column(model, x.name, name)]
                here = [o for o in owners if o.lower() in iterated]
                if name.lower() in known and name.lower() != m.name.lower():
                    edges.append((m.name, "MEASURE", known[name.lower()][1].name))
                elif t.name in owners:
                    edges.append((m.name, "COLUMN", f"{t.name}[{name}]"))
                elif len(owners) == 1 or len(here) == 1:
                    edges.append((m.name, "COLUMN", f"{(here or owners)[0]}[{name}]"))
                else:
                    gaps.append((m.name, f"[{name}]", "ambiguous: columns of " + ", ".join(owners) if owners else "unknown measure or column"))
            for table, name in qualified:
                owner = model.table(table)
                if owner is None:
                    gaps.append((m.name, f"{table}[{name}]", "unknown table"))
                elif has_column(model, table, name):
                    edges.append((m.name, "COLUMN", f"{owner.name}[{next(c.name for c in owner.columns if c.name.lower() == name.lower())}]"))
                elif name.lower() in known and known[name.lower()][0].lower() == table.lower():
                    edges.append((m.name, "MEASURE", known[name.lower()][1].name))
                else:
                    gaps.append((m.name, f"{owner.name}[{name}]", "unknown column"))
    return edges, gaps


def resolved(spark: SparkSession, *models: SemanticModel) -> tuple[DataFrame, DataFrame]:
    pairs = [(m.name, *resolve(m)) for m in models]
    edges = [(n, *e) for n, found, _ in pairs for e in found]
    gaps = [(n, f"Measure:{g[0]}", *g[1:]) for n, _, found in pairs for g in found]
    for m in models:
        for what, test in (("bidirectional", lambda r: r.cross_filter == "BOTH"), ("many-to-many", lambda r: r.cardinality == "MANY_TO_MANY")):
            for a, b in sorted({tuple(sorted((r.from_table, r.to_table))) for r in m.relationships if test(r)}):
                gaps.append((m.name, f"Relationship:{a}-{b}", f"{a}-{b}", f"{what} relationship needs a decision"))
    return spark.createDataFrame(edges, "model string, measure string, kind string, target string"), spark.createDataFrame(gaps, "model string, object_ref string, reference string, reason string")


# Why a reference that another tool calls unresolved does resolve.
FALSE_GAPS = {
    "case": "the name differs in letter case only", "column_other_table": "a column of an iterated table", "virtual_column": "a column that the expression adds",
    "qualified_measure": "a measure that lives in another table", "phantom": "text in a comment or a string", "confirmed": "it is unresolved", "other": "it resolves",
}


def classified_gaps(spark: SparkSession, model: SemanticModel, gaps: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``why`` to gaps (measure, reference) that another tool reports: confirmed, or why they are none.

    The references that expressions really have come as one frame; the verdict is a join.
    """
    known, rows = model.measures(), []
    for t in model.tables:
        for m in t.measures:
            qualified, bare = references(m.expression)
            try:
                added = {a.value.lower() for n in walk(parse(m.expression)) if isinstance(n, Call) and n.name in ("ADDCOLUMNS", "SUMMARIZE", "SELECTCOLUMNS") for a in n.args if isinstance(a, Lit) and isinstance(a.value, str)}
            except DaxError:
                added = set()
            open_ = {g[1].lower() for g in resolve(model)[1] if g[0] == m.name}
            for table, name in [*qualified, *[(None, n) for n in bare]]:
                shown = f"{table or ''}[{name}]"
                exact = any(m_.name == name for _, m_ in known.values()) or any(c.name == name for x in model.tables for c in x.columns)
                owner = known.get(name.lower())
                if name.lower() in added and table is None:
                    verdict = "virtual_column"
                elif shown.lower() in open_ and not (table is not None and owner is not None):
                    verdict = "confirmed"
                elif not exact:
                    verdict = "case"
                elif owner is not None and table is not None and owner[0].lower() != table.lower() and not has_column(model, table, name):
                    verdict = "qualified_measure"
                elif table is None and owner is None and not has_column(model, t.name, name):
                    verdict = "column_other_table"
                else:
                    verdict = "other"
                rows.append((m.name, shown, verdict))
    found = spark.createDataFrame(rows, "measure string, reference string, verdict string").distinct()
    why = F.coalesce(*[F.when(F.col("verdict") == k, v) for k, v in FALSE_GAPS.items()])
    return gaps.join(found, ["measure", "reference"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("phantom"))).withColumn("why", why)


# --- facts and dimensions


def dimension_like(name: Column) -> Column:
    lower = F.lower(name)
    return lower.isin("date", "calendar") | F.regexp_replace(lower, "^[-_ ]+", "").rlike("^(dim|d_|dimension|lookup)")


AGGREGATING = {"SUM", "SUMX", "AVERAGE", "AVERAGEX", "COUNT", "COUNTA", "COUNTX", "DISTINCTCOUNT", "DISTINCTCOUNTNOBLANK", "MIN", "MINX", "MAX", "MAXX", "COUNTROWS"}


def fact_groups(spark: SparkSession, model: SemanticModel) -> tuple[DataFrame, DataFrame]:
    """(measure, fact, evidence) and dimension candidates (table, facts that reach it).

    A measure belongs to its home table if that isn't named like a dimension; else to the table it aggregates most (true
    facts weigh 2, others 1), else to a referenced table, else to the fact of a measure it refers to.
    """
    votes, refs, deps, homes = [], [], [], []
    for t in model.tables:
        for m in t.measures:
            homes.append((m.name, t.name))
            try:
                nodes = list(walk(parse(m.expression)))
            except DaxError:
                nodes = []
            for n in nodes:
                if isinstance(n, Call) and n.name in AGGREGATING and n.args:
                    target = next((x for x in walk(n.args[0]) if isinstance(x, (TableRef, Ref)) and (getattr(x, "table", None) or isinstance(x, TableRef))), None)
                    if target is not None and (found := model.table(getattr(target, "table", None) or target.name)) is not None:
                        votes.append((m.name, found.name))
    for name, kind, target in resolve(model)[0]:
        (deps if kind == "MEASURE" else refs).append((name, target if kind == "MEASURE" else target.split("[")[0]))
    frame = lambda rows, names: spark.createDataFrame(rows, f"measure string, {names} string")
    tables = spark.createDataFrame([(t.name,) for t in model.tables], "fact string").withColumn("true_fact", ~dimension_like(F.col("fact")))
    home = frame(homes, "fact").join(F.broadcast(tables.where("true_fact")), "fact").select("measure", "fact", F.lit(1).alias("rank"), F.lit(1).alias("weight"), F.lit("home table").alias("evidence"))
    vote = frame(votes, "fact").join(F.broadcast(tables), "fact").groupBy("measure", "fact").agg(F.sum(F.when(F.col("true_fact"), 2).otherwise(1)).cast("int").alias("weight"), F.max("true_fact").alias("t"))
    vote = vote.select("measure", "fact", F.when(F.col("t"), 2).otherwise(3).alias("rank"), "weight", F.lit("aggregated most").alias("evidence"))
    ref = frame(refs, "fact").join(F.broadcast(tables), "fact").groupBy("measure", "fact").agg(F.max("true_fact").alias("t")).select("measure", "fact", F.when(F.col("t"), 4).otherwise(5).alias("rank"), F.lit(1).alias("weight"), F.lit("referenced").alias("evidence"))
    best = Window.partitionBy("measure").orderBy("rank", F.desc("weight"), "fact")
    own = home.unionByName(vote).unionByName(ref).withColumn("k", F.row_number().over(best)).where("k = 1").select("measure", "fact", "evidence")
    reach = closure(frame(deps, "dst").select(F.col("measure").alias("src"), "dst"))
    taken = reach.join(own.select(F.col("measure").alias("dst"), "fact"), "dst").join(own.select(F.col("measure").alias("src")), "src", "left_anti")
    first = Window.partitionBy("src").orderBy("steps", "dst")
    inherited = taken.withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("src").alias("measure"), "fact", F.lit("inherited").alias("evidence"))
    facts = own.unionByName(inherited)
    keys = spark.createDataFrame([(r.from_table, r.to_table) for r in model.relationships if r.is_active], "fact string, dimension string")
    dims = keys.join(facts.select("fact").distinct(), "fact").groupBy("dimension").agg(F.array_sort(F.collect_set("fact")).alias("facts"))
    return facts, dims
