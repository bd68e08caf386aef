"""The semantic model: tables, columns, measures, relationships; and the same as metadata frames."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

CONFIRMED, INFERRED, REQUIRES_INPUT = "CONFIRMED", "INFERRED", "REQUIRES_INPUT"

#: Model types -> Spark types.
TYPES = {
    "int64": "bigint", "double": "double", "decimal": "decimal(38,10)", "currency": "decimal(19,4)", "datetime": "timestamp",
    "date": "date", "string": "string", "boolean": "boolean", "binary": "binary",
}


def spark_type(name: str | None) -> str:
    return TYPES.get((name or "string").lower(), "string")


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str | None = None
    expression: str | None = None  # of a calculated column: Spark SQL over the table's own columns
    hidden: bool = False
    status: str = CONFIRMED
    path: str | None = None


@dataclass(frozen=True)
class Measure:
    name: str
    expression: str
    status: str = CONFIRMED
    format: str | None = None
    description: str | None = None
    path: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    source: str | None = None  # where the rows are; tables of one source are roles of it
    columns: tuple[Column, ...] = ()
    measures: tuple[Measure, ...] = ()
    table_type: str = "REGULAR"
    display_name: str | None = None
    hierarchies: tuple[tuple[str, tuple[str, ...]], ...] = ()
    source_hint: str | None = None
    status: str = CONFIRMED


@dataclass(frozen=True)
class Relationship:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    cardinality: str = "MANY_TO_ONE"
    cross_filter: str = "SINGLE"
    is_active: bool = True


@dataclass(frozen=True)
class SemanticModel:
    name: str
    tables: tuple[Table, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    features: dict = field(default_factory=dict)
    source_file: str | None = None

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name.lower() == name.lower()), None)

    def measures(self) -> dict[str, tuple[str, Measure]]:
        """Lower-case name -> (home table, measure)."""
        return {m.name.lower(): (t.name, m) for t in self.tables for m in t.measures}

    def with_measure(self, table: str, measure: Measure) -> SemanticModel:
        def put(t: Table) -> Table:
            if t.name.lower() != table.lower():
                return t
            return replace(t, measures=(*[m for m in t.measures if m.name.lower() != measure.name.lower()], measure))

        return replace(self, tables=tuple(map(put, self.tables)))


def identifier(*parts: str) -> str:
    """A stable id: the same object gets the same one on every run."""
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def validate(model: SemanticModel) -> tuple[list[str], list[str]]:
    """Fatal findings and warnings."""
    fatal, warn = [], []
    if not model.tables:
        fatal.append("the model has no tables")
    for kind, names in (("table", [t.name.lower() for t in model.tables]), ("measure", [m.name.lower() for t in model.tables for m in t.measures])):
        for n in sorted({n for n in names if names.count(n) > 1}):
            fatal.append(f"{kind} name is not unique: {n}")
    known = {t.name.lower() for t in model.tables}
    for r in model.relationships:
        for t in (r.from_table, r.to_table):
            if t.lower() not in known:
                fatal.append(f"a relationship names an unknown table: {t}")
    for t in model.tables:
        if not t.columns and not t.measures:
            warn.append(f"table is empty: {t.name}")
        for m in t.measures:
            if not m.expression.strip():
                warn.append(f"measure has no expression: {m.name}")
    return fatal, warn


SCHEMAS = {
    "tables": "model string, table_id string, name string, display_name string, table_type string, source_hint string, n_columns int, n_measures int, status string",
    "columns": "model string, table string, name string, data_type string, is_calculated boolean, expression string, hidden boolean, status string, path string",
    "measures": "model string, table string, name string, expression string, status string, path string",
    "relationships": "model string, from_table string, from_column string, to_table string, to_column string, cardinality string, cross_filter string, is_active boolean",
}


def frames(spark: SparkSession, *models: SemanticModel) -> dict[str, DataFrame]:
    """The catalog of models as frames: tables, columns, measures, relationships."""
    rows: dict[str, list] = {k: [] for k in SCHEMAS}
    for m in models:
        for t in m.tables:
            rows["tables"].append((m.name, identifier("table", m.name, t.name), t.name, t.display_name, t.table_type, t.source_hint, len(t.columns), len(t.measures), t.status))
            rows["columns"] += [(m.name, t.name, c.name, c.data_type, c.expression is not None, c.expression, c.hidden, c.status, c.path) for c in t.columns]
            rows["measures"] += [(m.name, t.name, x.name, x.expression, x.status, x.path) for x in t.measures]
        rows["relationships"] += [(m.name, r.from_table, r.from_column, r.to_table, r.to_column, r.cardinality, r.cross_filter, r.is_active) for r in m.relationships]
    return {k: spark.createDataFrame(rows[k], SCHEMAS[k]) for k in SCHEMAS}
