"""Projects and views on disk: metadata tables partitioned by project, YAML views, packs of queries, DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.model import SCHEMAS, Column, Measure, Relationship, SemanticModel, Table, frames, spark_type
from starweave.plans.dax import DaxError, parse, snake, to_sql
from starweave.plans.metricview import MetricView


class ProjectStore:
    """Models of projects as Parquet: one table for each kind of metadata, partitioned by project.

    Saving a project replaces its partition, so reading a file in again replaces what it gave before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, project: str, *models: SemanticModel) -> None:
        made = self.spark.createDataFrame([(project,)], "project string").withColumn("created_at", F.current_timestamp())
        for kind, rows in (frames(self.spark, *models) | {"projects": made}).items():
            rows = rows.withColumn("project_id", F.lit(project)).coalesce(1)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{self.folder}/{kind}")

    def table(self, kind: str) -> DataFrame:
        schema = "project string, created_at timestamp" if kind == "projects" else SCHEMAS[kind]
        return self.spark.read.schema(f"{schema}, project_id string").parquet(f"{self.folder}/{kind}")

    def projects(self) -> DataFrame:
        return self.table("projects").select("project_id", "created_at").orderBy(F.desc("created_at"), "project_id")

    def get(self, project: str) -> dict[str, DataFrame]:
        return {k: self.table(k).where(F.col("project_id") == project) for k in SCHEMAS}

    def load(self, project: str) -> list[SemanticModel]:
        """The models again, from their tables (a model's metadata is small)."""
        rows = {k: df.collect() for k, df in self.get(project).items()}
        out = []
        for name in sorted({r.model for r in rows["tables"]}):
            tables = []
            for t in (r for r in rows["tables"] if r.model == name):
                own = [r for r in rows["columns"] if (r.model, r.table) == (name, t.name)]
                measures = [Measure(r.name, r.expression, r.status, path=r.path) for r in rows["measures"] if (r.model, r.table) == (name, t.name)]
                tables.append(Table(t.name, None, tuple(Column(c.name, c.data_type, c.expression, c.hidden, c.status, c.path) for c in own), tuple(measures), t.table_type, t.display_name, (), t.source_hint, t.status))
            keys = [Relationship(r.from_table, r.from_column, r.to_table, r.to_column, r.cardinality, r.cross_filter, r.is_active) for r in rows["relationships"] if r.model == name]
            out.append(SemanticModel(name, tuple(tables), tuple(keys)))
        return out

    def delete(self, project: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for kind in (*SCHEMAS, "projects"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/project_id={project}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- views as YAML


def view_yaml(view: MetricView, measures: list[str] | None = None) -> str:
    """The view as YAML text: source, joins, dimensions, and measures with SQL and their own expression as comment."""
    import yaml

    fact = view.fact.name
    joins, dims, seen = [], [], set()
    for t, path in view.paths().items():
        table = view.model.table(t)
        if path:
            r = path[-1]
            joins.append({"name": snake(table.name), "source": table.source or table.name, "on": f"{'source' if r.from_table == fact else snake(r.from_table)}.{r.from_column} = {snake(table.name)}.{r.to_column}", "type": view.join})
        for c in table.columns:
            if not c.hidden and c.name not in seen:
                seen.add(c.name)
                dims.append({"name": c.name, "expr": f"{snake(table.name) if path else 'source'}.{snake(c.name)}"})
        for h, levels in table.hierarchies:
            dims += [{"name": f"{h} L{i + 1} ({c})", "expr": f"{snake(table.name) if path else 'source'}.{snake(c)}"} for i, c in enumerate(levels)]
    found = []
    for name, text in view.measures_by_name.items():
        if measures is None or name in {m.lower() for m in measures}:
            try:
                found.append({"name": name, "expr": f"{to_sql(parse(text), fact)} -- DAX: {' '.join(text.split())}", "source_dax": text})
            except DaxError:
                continue
    body = {"version": "1.1", "source": view.fact.source or fact, "joins": joins, "dimensions": dims, "measures": found}
    return "# A metric view; expressions are Spark SQL.\n" + yaml.safe_dump(body, sort_keys=False, allow_unicode=True, width=10_000)


def view_from_yaml(text: str, view: MetricView) -> MetricView:
    """Measures and dimensions of YAML text put on a view; ``fields`` and ``dimensions`` both work, also an unquoted ``on``."""
    import yaml

    body = yaml.safe_load(text)
    for j in body.get("joins") or []:
        j.setdefault("on", j.pop(True, None))
    if len({j.get("type", "left") for j in body.get("joins") or []}) == 1:
        view.join = body["joins"][0].get("type", "left")
    for d in body.get("dimensions") or body.get("fields") or []:
        alias, _, column = d["expr"].rpartition(".")
        table = view.fact.name if alias in ("", "source") else next((t.name for t in view.model.tables if snake(t.name) == alias), None)
        named = table and next((c.name for c in view.model.table(table).columns if snake(c.name) == column), None)
        if named:
            view.with_dimension(d["name"], table, named)
    for m in body.get("measures") or []:
        if m.get("source_dax"):
            view.with_measure(m["name"], m["source_dax"])
    return view


def view_ddl(name: str, view: MetricView) -> str:
    return f"CREATE OR REPLACE VIEW {name} WITH METRICS LANGUAGE YAML AS $$\n{view_yaml(view)}$$"


def table_ddl(table: Table, name: str | None = None) -> str:
    """A CREATE TABLE for a table that is missing, with typed columns."""
    columns = ",\n  ".join(f"`{snake(c.name)}` {spark_type(c.data_type).upper()}" for c in table.columns if not c.expression)
    return f"CREATE TABLE IF NOT EXISTS {name or snake(table.name)} (\n  {columns}\n) USING PARQUET"


def query_pack(view: MetricView, measures: list[str], slices: list[list[str]]) -> dict[str, DataFrame]:
    """Each measure at each slice, keyed ``measure|slice``, to be compared with another system's figures."""
    return {f"{m}|{', '.join(s) or 'total'}": view.query(s, [m], order_by=s) for m in measures for s in slices}


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Report tables as CSV with headers, one folder each."""
    for name, rows in sheets.items():
        flat = rows.select(*[F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in rows.dtypes])
        flat.write.mode("overwrite").option("header", "true").csv(f"{folder.rstrip('/')}/{name}")
