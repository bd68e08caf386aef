"""Lineage and inventories over the metadata frames of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.model import SemanticModel, frames
from starweave.operators.scoring import classify, fact_groups, resolved, settled
from starweave.sources.models import HINT, hint_parts


def node_id(kind: str, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts), 256), 1, 16)


def lineage(spark: SparkSession, *models: SemanticModel) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, model, label, is_system, detail) and edges (src, dst, kind); ids are stable."""
    meta = frames(spark, *models)
    refs, _ = resolved(spark, *models)
    m = F.col("model")
    model_nodes = meta["tables"].select("model").distinct().select(node_id("model", m).alias("id"), F.lit("MODEL").alias("kind"), "model", m.alias("label"), F.lit(False).alias("is_system"), F.create_map().cast("map<string,string>").alias("detail"))
    part = lambda df, kind, key, label, system, detail: df.select(node_id(kind.lower(), *key).alias("id"), F.lit(kind).alias("kind"), "model", label.alias("label"), system.alias("is_system"), detail.alias("detail"))
    t, c, x, r = (meta[k] for k in ("tables", "columns", "measures", "relationships"))
    no = F.lit(False)
    detail = lambda *names: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]))
    hint = t.where(F.col("source_hint").startswith(HINT)).withColumn("object", hint_parts(F.col("source_hint")))
    full = F.concat_ws(".", "object.database", "object.schema", "object.object")
    column = F.concat(F.col("table"), F.lit("["), F.col("name"), F.lit("]"))
    rel = F.concat(F.col("from_table"), F.lit("["), F.col("from_column"), F.lit("] -> "), F.col("to_table"), F.lit("["), F.col("to_column"), F.lit("]"))
    nodes = (
        model_nodes.unionByName(part(t, "TABLE", (m, F.col("name")), F.coalesce("display_name", "name"), F.col("display_name").isNotNull(), detail("table_type", "status")))
        .unionByName(part(c, "COLUMN", (m, column), column, no, detail("data_type", "is_calculated")))
        .unionByName(part(x, "MEASURE", (m, F.col("name")), F.col("name"), no, detail("table", "expression")))
        .unionByName(part(r, "RELATIONSHIP", (m, rel), rel, no, detail("cardinality", "cross_filter", "is_active")))
        .unionByName(part(hint, "SOURCE", (full,), full, no, detail("source_hint")).dropDuplicates(["id"]))
    )
    edge = lambda df, kind, src, dst: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    table_id = lambda name: node_id("table", m, F.col(name))
    edges = (
        edge(t, "CONTAINS_TABLE", node_id("model", m), table_id("name"))
        .unionByName(edge(c, "HAS_COLUMN", table_id("table"), node_id("column", m, column)))
        .unionByName(edge(x, "HAS_MEASURE", table_id("table"), node_id("measure", m, F.col("name"))))
        .unionByName(edge(r, "RELATES_FROM", table_id("from_table"), node_id("relationship", m, rel)))
        .unionByName(edge(r, "RELATES_TO", node_id("relationship", m, rel), table_id("to_table")))
        .unionByName(edge(hint, "SOURCED_FROM", table_id("name"), node_id("source", full)))
        .unionByName(edge(refs.where("kind = 'MEASURE'"), "USES_MEASURE", node_id("measure", m, F.col("measure")), node_id("measure", m, F.col("target"))))
        .unionByName(edge(refs.where("kind = 'COLUMN'"), "USES_COLUMN", node_id("measure", m, F.col("measure")), node_id("column", m, F.col("target"))))
    )
    return nodes, edges.distinct()


def reachable(edges: DataFrame, start: str, direction: str = "downstream") -> DataFrame:
    """(id, distance) of all nodes that ``start`` leads to (downstream), that lead to it (upstream), or both.

    Breadth first: a round joins the front with the edges and drops nodes that are known.
    """
    ways = {"downstream": [("src", "dst")], "upstream": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    spark, out = edges.sparkSession, None
    edges = settled(edges.select("src", "dst").distinct())
    for a, b in ways:
        on = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
        found = front = spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("distance"))
        while True:
            further = front.join(on, "id").select(F.col("next").alias("id"), (F.col("distance") + 1).alias("distance")).distinct()
            front = settled(further.join(found.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            found = found.unionByName(front)
        out = found if out is None else out.unionByName(found).groupBy("id").agg(F.min("distance").alias("distance"))
    return out


def visible(nodes: DataFrame, edges: DataFrame, hide_system: bool = True, tables_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The subgraph without system tables, and on request without columns and measures."""
    kept = nodes.where(~F.col("is_system")) if hide_system else nodes
    kept = kept.where(~F.col("kind").isin("COLUMN", "MEASURE")) if tables_only else kept
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def search(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("label"), F.lit(text.lower())))


def snapshot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of JSON with all nodes and edges (metadata: bounded by the model's size)."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "kind", "model", "label", "is_system"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst", "kind"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("graph"))


# --- inventories


def table_inventory(meta: dict[str, DataFrame], hide_system: bool = False) -> DataFrame:
    rows = meta["tables"].select("model", "name", "display_name", "source_hint", "n_columns", "n_measures", "status")
    return rows.where("display_name is null") if hide_system else rows


def measure_inventory(spark: SparkSession, *models: SemanticModel) -> DataFrame:
    meta = frames(spark, *models)
    done = classify(spark, *models).select("model", "name", "score", "band", "bucket", "category", "depth", "functions", F.col("measures").alias("referenced_measures"), "tables", "reasons")
    return meta["measures"].select("model", "table", "name", "expression", "status").join(done, ["model", "name"])


def relationship_inventory(meta: dict[str, DataFrame]) -> DataFrame:
    names = meta["tables"].select("model", "name", F.coalesce("display_name", "name").alias("shown"))
    left, right = names.toDF("model", "from_table", "from_name"), names.toDF("model", "to_table", "to_name")
    return meta["relationships"].join(left, ["model", "from_table"], "left").join(right, ["model", "to_table"], "left").select("model", "from_table", "from_name", "from_column", "to_table", "to_name", "to_column", "cardinality", "cross_filter", "is_active")


def gap_inventory(spark: SparkSession, *models: SemanticModel) -> DataFrame:
    return resolved(spark, *models)[1]


def referenced_objects(meta: dict[str, DataFrame]) -> DataFrame:
    """Objects of the upstream database that tables come from."""
    rows = meta["tables"].where("display_name is null").where(F.col("source_hint").startswith(HINT))
    return rows.select("model", F.col("name").alias("table"), hint_parts(F.col("source_hint")).alias("o")).select("model", "table", "o.*")


def unresolved_tables(meta: dict[str, DataFrame]) -> DataFrame:
    return meta["tables"].where("display_name is null and source_hint is null").select("model", F.col("name").alias("table"), "table_type")


def shared_tables(meta: dict[str, DataFrame]) -> DataFrame:
    """Names that several models use."""
    rows = meta["tables"].where("display_name is null").groupBy(F.lower("name").alias("name")).agg(F.array_sort(F.collect_set("model")).alias("models"))
    return rows.where(F.size("models") > 1)


def dashboard(spark: SparkSession, *models: SemanticModel) -> DataFrame:
    """Counts of one project in one row."""
    meta = frames(spark, *models)
    own = meta["tables"].where("display_name is null").select("model", F.col("name").alias("table"))
    counts = {
        "tables": own.agg(F.count("*").cast("int").alias("tables"), F.count_distinct("model").cast("int").alias("models")),
        "columns": meta["columns"].join(own, ["model", "table"], "left_semi").agg(F.count("*").cast("int").alias("columns")),
        "measures": classify(spark, *models).agg(F.count("*").cast("int").alias("measures"), *[F.count_if(F.col("bucket") == b).cast("int").alias(b.lower()) for b in ("LOW", "MEDIUM", "HIGH")]),
        "relationships": meta["relationships"].agg(F.count("*").cast("int").alias("relationships")),
        "gaps": gap_inventory(spark, *models).agg(F.count("*").cast("int").alias("gaps")),
    }
    out = None
    for row in counts.values():
        out = row if out is None else out.crossJoin(row)
    return out


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def open_features(relationships: DataFrame) -> DataFrame:
    """(model, penalty): 5 points for each model trait that needs a decision, 20 at most."""
    one = relationships.groupBy("model").agg((F.max((F.col("cross_filter") == "BOTH").cast("int")) + F.max((F.col("cardinality") == "MANY_TO_MANY").cast("int")) + F.max((~F.col("is_active")).cast("int"))).alias("traits"))
    return one.select("model", F.least(5 * F.col("traits"), F.lit(20)).alias("penalty"))


def model_score(rows: DataFrame, usage: DataFrame | None = None, penalty: int | DataFrame = 0) -> DataFrame:
    """The mean score of each model's measures, weighted by usage (1 where unknown), less a penalty: a number, or one for each model."""
    if usage is not None:
        rows = rows.join(usage, ["model", "name"], "left").withColumn("w", F.coalesce("usage", F.lit(1)).cast("double"))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    mean = rows.groupBy("model").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("mean"))
    if isinstance(penalty, DataFrame):
        return mean.join(penalty.select("model", "penalty"), "model", "left").select("model", (F.col("mean") - F.coalesce("penalty", F.lit(0))).alias("model_score"))
    return mean.select("model", (F.col("mean") - penalty).alias("model_score"))


# The phases of a migration (key, tasks), and what the later ones wait for.
PHASES = {
    "discovery": ["inventory", "model extraction", "source dependencies", "missing metadata"],
    "source_assessment": ["resolve views", "base tables", "transformations", "incremental strategies"],
    "bronze": ["ingest", "create tables", "incremental processing"],
    "silver": ["clean", "normalise", "deduplicate", "conform", "transform"],
    "gold": ["facts", "dimensions", "bridges", "aggregates"],
    "report_migration": ["replace connections", "connect to the target", "keep semantic logic"],
    "validation": ["data", "relationships", "measures", "reports", "performance"],
    "parallel_run": ["run both", "compare"],
    "cutover": ["deploy", "monitor", "retire"],
}


def phase_plan(spark: SparkSession, *models: SemanticModel) -> DataFrame:
    """(phase, key, status, tasks, blocked, items): phases with what is open in each, counted from the models.

    Discovery is confirmed once there are models. The source's assessment has an item for each upstream object, gold for each
    fact, validation for each measure; a phase without its input says what it waits for.
    """
    phases = spark.createDataFrame([(k + 1, key, tasks) for k, (key, tasks) in enumerate(PHASES.items())], "phase int, key string, tasks array<string>")
    counted = None
    if models:
        meta = frames(spark, *models)
        facts = None
        for m in models:
            part = fact_groups(spark, m)[0].select(F.concat_ws(".", F.lit(m.name), "fact").alias("item"))
            facts = part if facts is None else facts.unionByName(part)
        parts = {
            "discovery": meta["tables"].select(F.concat_ws(".", "model", "name").alias("item")), "source_assessment": referenced_objects(meta).select(F.concat_ws(".", "database", "schema", "object").alias("item")),
            "gold": facts, "validation": meta["measures"].select(F.concat_ws(".", "model", "name").alias("item")),
        }
        for key, rows in parts.items():
            one = rows.distinct().agg(F.array_sort(F.collect_list("item")).alias("items")).select(F.lit(key).alias("key"), "items")
            counted = one if counted is None else counted.unionByName(one)
    else:
        counted = spark.createDataFrame([], "key string, items array<string>")
    done = F.lit(bool(models)) & (F.col("key") == "discovery")
    blocked = F.when(~done, F.when(F.col("key") == "discovery", "no model has been read yet").otherwise("its input isn't there yet"))
    out = phases.join(F.broadcast(counted), "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("phase", "key", F.when(done, "CONFIRMED").otherwise("REQUIRES_INPUT").alias("status"), "tasks", blocked.alias("blocked"), "items")


# Sections of the report that need more than metadata, with what they need.
DEFERRED = {
    "power_query_analysis": "queries", "source_inventory": "the source's DDL", "source_dependency_analysis": "the source's DDL", "source_to_target_mapping": "source and target",
    "target_architecture": "a target", "bronze_design": "base tables", "silver_design": "base tables", "fact_grain_definitions": "a source key", "report_migration_strategy": "classified measures",
    "data_quality_strategy": "quality rules", "validation_strategy": "parity figures", "performance_strategy": "query plans", "security_strategy": "roles", "cicd_strategy": "a scope",
    "migration_complexity": "a target", "dependency_aware_sequence": "dependencies of both sides", "parallel_run": "a target", "cutover_plan": "a finished migration",
    "rollback_plan": "a finished migration", "risks": "the project's context", "assumptions": "the project's context",
}


def report(spark: SparkSession, *models: SemanticModel) -> DataFrame:
    """(section, status, n, details) of an assessment: ten sections from the models, and those that need more, with what they need."""
    meta = frames(spark, *models)
    nodes, edges = lineage(spark, *models)
    gaps = gap_inventory(spark, *models)
    facts = None
    for m in models:
        part = fact_groups(spark, m)[0].withColumn("model", F.lit(m.name))
        facts = part if facts is None else facts.unionByName(part)
    board = dashboard(spark, *models)
    every = classify(spark, *models)
    sections = [
        ("scope", meta["tables"].select("model").distinct().select(F.col("model").alias("d"))),
        ("current_state", board.select(F.inline(F.array(*[F.struct(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")).alias("d")) for c in board.columns])))),
        ("tables", table_inventory(meta, True).select(F.concat_ws(": ", "model", "name").alias("d"))),
        ("measures", every.select(F.concat_ws(": ", "name", "band").alias("d"))),
        ("shared_tables", shared_tables(meta).select(F.col("name").alias("d"))),
        ("lineage", histogram(edges, "kind").select(F.concat_ws(": ", "kind", F.col("n").cast("string")).alias("d")).unionByName(histogram(nodes, "kind").select(F.concat_ws(": ", "kind", F.col("n").cast("string")).alias("d")))),
        ("gaps", gaps.select(F.concat_ws(": ", "object_ref", "reason").alias("d")).unionByName(unresolved_tables(meta).select(F.concat_ws(": ", "model", F.concat("table", F.lit(" has no source"))).alias("d")))),
        ("facts", facts.groupBy("model", "fact").agg(F.count("*").alias("n")).select(F.concat_ws(": ", "model", "fact", F.col("n").cast("string")).alias("d")) if facts is not None else None),
        ("conversion", histogram(every, "band").select(F.concat_ws(": ", "band", F.col("n").cast("string")).alias("d"))),
        ("open_questions", gaps.where(F.col("object_ref").startswith("Relationship:")).select(F.concat_ws(": ", "object_ref", "reason").alias("d"))),
    ]
    out = spark.createDataFrame([(k, "REQUIRES_INPUT", 0, [f"needs {v}"]) for k, v in DEFERRED.items()], "section string, status string, n int, details array<string>")
    for key, rows in sections:
        if rows is not None:
            one = rows.agg(F.array_sort(F.collect_list("d")).alias("details")).select(F.lit(key).alias("section"), F.lit("CONFIRMED").alias("status"), F.size("details").alias("n"), "details")
            out = out.unionByName(one)
    return out
