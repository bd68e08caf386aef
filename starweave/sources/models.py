"""Model files: shape detection, the JSON and the indented text form, upstream sources, corpora of files.

A model file is small and its text form is strictly sequential, so files are parsed on the driver; a corpus of files is
found and classified by Spark.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.model import CONFIRMED, REQUIRES_INPUT, Column, Measure, Relationship, SemanticModel, Table

# Names of detected shapes, the hint's prefix, the prefix of a view's name.
POWER_BI_MODEL, TMDL_MODEL, TERADATA_EXPORT, DATABRICKS_EXPORT, UNKNOWN = "POWER_BI_MODEL", "TMDL_MODEL", "TERADATA_METADATA", "DATABRICKS_METADATA", "UNKNOWN_GENERIC"
HINT, VIEW_PREFIX, SOURCE_CALL = "Teradata: ", "V_", "Teradata.Database"
AUTO_DATE = ("__PBI_LocalDateTable", "__PBI_TemplateDateTable")


class InvalidModel(ValueError):
    """The file is neither JSON nor the text form."""


# --- detection


def detect(text: str) -> str:
    """The shape of a file's text."""
    if re.search(r"(?m)^\s*(createOrReplace|model\s+\S|table\s+\S|relationship\s+\S)", text) and not text.lstrip().startswith(("{", "[")):
        return TMDL_MODEL
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise InvalidModel(str(e)) from e
    if not isinstance(found, dict):
        return UNKNOWN
    if isinstance(found.get("model"), dict) and isinstance(found["model"].get("tables"), list):
        return POWER_BI_MODEL
    platform = str(found.get("platform", "")).lower()
    if platform == "teradata" and isinstance(found.get("objects"), list):
        return TERADATA_EXPORT
    return DATABRICKS_EXPORT if platform == "databricks" else UNKNOWN


def detected(text: SparkColumn) -> SparkColumn:
    """The same for a column of texts; a text that is no JSON gives null."""
    body = F.trim(text)
    parsed = F.try_parse_json(body)
    braces = body.startswith("{") | body.startswith("[")
    tables, platform = F.get_json_object(body, "$.model.tables"), F.lower(F.get_json_object(body, "$.platform"))
    return (
        F.when(~braces & body.rlike(r"(?m)^\s*(createOrReplace|model\s+\S|table\s+\S|relationship\s+\S)"), TMDL_MODEL)
        .when(parsed.isNull(), F.lit(None))
        .when(tables.startswith("["), POWER_BI_MODEL)
        .when((platform == "teradata") & F.get_json_object(body, "$.objects").startswith("["), TERADATA_EXPORT)
        .when(platform == "databricks", DATABRICKS_EXPORT)
        .otherwise(UNKNOWN)
    )


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Model files below a folder: path, kind, shape, the model's folder (of a project); what is skipped says why.

    A project keeps one model as many text files below the folder that holds ``model.tmdl``: they are one model, and a
    ``model.bim`` beside it is an old copy. Folders of reports hold no models.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    text = F.when(kind.isin("json", "bim", "tmdl"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.select("path", kind.alias("kind"), "length", detected(text).alias("shape"), parent.alias("parent"))
    roots = rows.where(F.col("path").endswith("/model.tmdl")).select(F.col("parent").alias("root"))
    # a file belongs to the root among its own parent folders: an equi-join on all of these
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    owned = rows.select("path", F.explode(up).alias("root")).join(roots, "root").groupBy("path").agg(F.max("root").alias("root"))
    stale = roots.select(F.concat(F.regexp_extract("root", r"^(.*)/[^/]*$", 1), F.lit("/model.bim")).alias("path"), F.lit(True).alias("stale"))
    rows = rows.join(owned, "path", "left").join(stale, "path", "left")
    skipped = (
        F.when(F.contains("path", F.lit(".Report/")), "part of a report").when(F.col("kind") == "pbix", "binary report files aren't read; a template can be").when(F.coalesce("stale", F.lit(False)), "an old copy of the text form beside it")
        .when(~F.col("kind").isin("json", "bim", "tmdl", "pbit"), "not a model file").when(F.col("shape").isNull() & (F.col("kind") != "pbit") & F.col("root").isNull(), "no valid JSON")
    )
    return rows.select("path", F.when(F.col("root").isNotNull(), "project").otherwise(F.col("kind")).alias("kind"), "length", F.when(F.col("kind") == "pbit", POWER_BI_MODEL).otherwise(F.col("shape")).alias("shape"), "root", skipped.alias("skipped"))


# --- upstream sources


#: What a query is made of: texts and quoted names, words with dots, single signs.
QUERY_TOKEN = re.compile(r'#?"(?:[^"]|"")*"|[\w.]+|\S')


def is_text(token: str) -> bool:
    return token.startswith('"')


def unquoted(token: str) -> str:
    return token.removeprefix("#")[1:-1].replace('""', '"') if token.endswith('"') else token


def settings(found: list[str]) -> dict[str, str]:
    """Of each name that a sign of equality follows, the first token behind it."""
    out: dict[str, str] = {}
    for name, sign, value in zip(found, found[1:], found[2:], strict=False):
        if sign == "=":
            out.setdefault(name, value)
    return out


def parameter_value(expression: str | None) -> str | None:
    """The literal of a query parameter: a text whose metadata record says that it is one."""
    found = QUERY_TOKEN.findall(expression or "")
    if len(found) < 3 or not is_text(found[0]) or found[1].lower() != "meta" or found[2] != "[":
        return None
    record = settings(found[3 : found.index("]") if "]" in found else None])
    says = {name.lower(): value.lower() for name, value in record.items()}
    return unquoted(found[0]) if says.get("isparameterquery") == "true" else None


def source_parts(query: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(database as text, name of the parameter that holds it, schema, object) of an import query's call of the source."""
    found = QUERY_TOKEN.findall(query or "")
    at = next((i for i, (name, sign) in enumerate(zip(found, found[1:], strict=False)) if (name, sign) == (SOURCE_CALL, "(")), None)
    first = found[at + 2] if at is not None and at + 2 < len(found) else ""
    if not (len(unquoted(first)) if '"' in first else re.match(r"[^\W\d]", first)):
        return None, None, None, None
    texts = {name: unquoted(value) for name, value in settings(found[at:]).items() if is_text(value) and len(value) > 2}
    database, named = (unquoted(first), None) if is_text(first) else (None, unquoted(first))
    return database, named, texts.get("Schema"), texts.get("Name") or texts.get("Item")


def source_hint(query: str, parameters: dict[str, str]) -> str | None:
    """``Teradata: database.schema.object`` of an import query; the database may be named by a parameter."""
    database, named, *rest = source_parts(query)
    database = database or parameters.get(named, named)
    return HINT + ".".join(x for x in (database, *rest) if x) if database else None


def source_hints(queries: DataFrame, parameters: DataFrame) -> DataFrame:
    """(table, hint) of many import queries (table, query), their parameters (name, value) joined in."""

    @F.pandas_udf("database string, name string, schema string, object string")
    def parts(query: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([source_parts(q) for q in query], columns=["database", "name", "schema", "object"])

    rows = queries.select("table", parts("query").alias("p")).select("table", "p.*").where("database is not null or name is not null")
    both = rows.join(parameters.select("name", "value"), "name", "left").withColumn("database", F.coalesce("database", "value", "name"))
    return both.select("table", F.concat(F.lit(HINT), F.concat_ws(".", "database", "schema", "object")).alias("hint"))


def hint_parts(hint: SparkColumn) -> SparkColumn:
    """A hint as struct(database, schema, object, object_type); hosts may hold dots."""
    p = F.split(F.substr(hint, F.lit(len(HINT) + 1)), "\\.")
    n = F.size(p)
    database = F.array_join(F.slice(p, F.lit(1), F.greatest(n - 2, F.lit(1))), ".")
    schema, name = F.when(n >= 3, F.get(p, n - 2)).when(n == 2, F.get(p, F.lit(1))), F.when(n >= 3, F.get(p, n - 1))
    kind = F.when(F.upper(name).startswith(VIEW_PREFIX), "VIEW").when(name.isNotNull(), "BASE_TABLE")
    return F.struct(database.alias("database"), schema.alias("schema"), name.alias("object"), kind.alias("object_type"))


def cardinality(from_side: str | None, to_side: str | None) -> str:
    return f"{(from_side or 'many').upper()}_TO_{(to_side or 'one').upper()}"


def direction(text: str | None) -> str:
    return "BOTH" if re.search("both|bidirectional", text or "", re.I) else "SINGLE"


def lines(value) -> str:
    return "\n".join(value) if isinstance(value, list) else str(value or "")


# --- JSON


def unwrapped(found: dict) -> dict:
    """The model below commands that create or replace it."""
    for key in ("createOrReplace", "create"):
        if key in found:
            found = found[key].get("database", found[key])
    return found


def from_json(text: str, name: str | None = None, source_file: str | None = None) -> SemanticModel:
    root = unwrapped(json.loads(text.removeprefix("﻿")))
    body = root.get("model", root)
    parameters = {e["name"]: v for e in body.get("expressions", []) if (v := parameter_value(lines(e.get("expression")))) is not None}
    tables = []
    for i, t in enumerate(body.get("tables") or []):
        at = f"$.model.tables[{i}]"
        columns = tuple(
            Column(c.get("name") or f"UnnamedColumn{k}", c.get("dataType"), lines(c["expression"]) if c.get("expression") else None, bool(c.get("isHidden")), CONFIRMED, f"{at}.columns[{k}]")
            for k, c in enumerate(t.get("columns") or [])
            if c.get("type") != "rowNumber"
        )
        measures = []
        for k, m in enumerate(t.get("measures") or []):
            e = lines(m.get("expression")).strip()
            measures.append(Measure(m.get("name") or f"UnnamedMeasure{k}", e, CONFIRMED if e else REQUIRES_INPUT, m.get("formatString"), m.get("description"), f"{at}.measures[{k}]"))
        queries = [lines((p.get("source") or {}).get("expression")) for p in t.get("partitions") or []]
        hint = next((h for q in queries if (h := source_hint(q, parameters))), None) or (t["source"] if isinstance(t.get("source"), str) else None)
        levels = tuple((h["name"], tuple(x.get("column") or x.get("name") for x in sorted(h.get("levels", []), key=lambda x: x.get("ordinal", 0)))) for h in t.get("hierarchies") or [])
        auto = any(a.get("name") in AUTO_DATE and str(a.get("value")).lower() == "true" for a in t.get("annotations") or [])
        tables.append(Table(t.get("name") or f"UnnamedTable{i}", None, columns, tuple(measures), "AUTO_DATE" if auto else t.get("tableType", "REGULAR"), None, levels, hint))
    relationships = tuple(
        Relationship(r["fromTable"], r["fromColumn"], r["toTable"], r["toColumn"], r.get("cardinality") or cardinality(r.get("fromCardinality"), r.get("toCardinality")), direction(r.get("crossFilteringBehavior") or r.get("crossFilterDirection")), bool(r.get("isActive", True)))
        for r in body.get("relationships") or []
    )
    return labelled(SemanticModel(name or root.get("name") or body.get("name") or "model", tuple(tables), relationships, features(body, relationships), source_file))


def features(body: dict, relationships: Iterable[Relationship]) -> dict:
    """What a model has beyond tables: counts."""
    tables = body.get("tables") or []
    relationships = list(relationships)
    return {
        "roles": len(body.get("roles") or []),
        "rls_filters": sum(len(r.get("tablePermissions") or []) for r in body.get("roles") or []),
        "calculation_groups": sum(bool(t.get("calculationGroup")) for t in tables),
        "calculated_tables": sum(any((p.get("source") or {}).get("type") == "calculated" for p in t.get("partitions") or []) for t in tables),
        "hierarchies": sum(len(t.get("hierarchies") or []) for t in tables),
        "perspectives": len(body.get("perspectives") or []),
        "cultures": len(body.get("cultures") or []),
        "calculated_columns": sum(bool(c.get("expression")) for t in tables for c in t.get("columns") or []),
        "kpis": sum(bool(m.get("kpi")) for t in tables for m in t.get("measures") or []),
        "calculation_items": sum(len((t.get("calculationGroup") or {}).get("calculationItems") or []) for t in tables),
    } | of_relationships(relationships)


def of_relationships(relationships: list[Relationship]) -> dict:
    return {
        "bidirectional": sum(r.cross_filter == "BOTH" for r in relationships), "inactive": sum(not r.is_active for r in relationships),
        "many_to_many": sum(r.cardinality == "MANY_TO_MANY" for r in relationships),
    }


def labelled(model: SemanticModel) -> SemanticModel:
    """Automatic date tables named after the first column that joins them."""
    out = []
    for t in model.tables:
        if t.table_type == "AUTO_DATE":
            r = next((r for r in model.relationships if r.to_table == t.name), None)
            t = replace(t, display_name=f"Date table for {r.from_table}.{r.from_column}" if r else "Automatic date table")
        out.append(t)
    return replace(model, tables=tuple(out))


# --- the indented text form


@dataclass
class Node:
    keyword: str
    rest: str
    depth: int
    children: list[Node] = field(default_factory=list)
    body: list[str] = field(default_factory=list)

    def text(self) -> str:
        return "\n".join(self.body).strip()


NAMED = ("measure", "column", "partition", "expression", "source", "calculationItem", "tablePermission", "annotation", "changedProperty")


def nodes(text: str) -> list[Node]:
    """The tree of the text form: tabs nest, fenced and deeper lines are an expression's body."""
    roots: list[Node] = []
    stack: list[Node] = []
    fence: Node | None = None
    for raw in text.removeprefix("﻿").splitlines():
        line = raw.strip()
        if fence is not None:
            if line.endswith("```"):
                if line[:-3].strip():
                    fence.body.append(line[:-3])
                fence = None
            else:
                fence.body.append(line)
            continue
        if not line or line.startswith("///"):
            continue
        depth = len(raw) - len(raw.lstrip("\t"))
        while stack and stack[-1].depth >= depth:
            stack.pop()
        top = stack[-1] if stack else None
        if top is not None and top.keyword in NAMED and top.rest.rstrip().endswith("=") and depth > top.depth + 1 or top is not None and top.keyword == "source" and depth > top.depth:
            top.body.append(line)
            continue
        if line.startswith("//"):
            continue
        word, _, rest = line.partition(" ")
        if ":" in word:
            word, _, tail = line.partition(":")
            rest = ": " + tail.strip()
        node = Node(word.strip(), rest.strip(), depth)
        if line.endswith("```") and line.count("```") == 1:
            node.rest, fence = node.rest[: -3].rstrip(), node
        (top.children if top else roots).append(node)
        stack.append(node)
    return roots


def every(roots: list[Node], keyword: str) -> list[Node]:
    out = []
    for n in roots:
        out += [n] if n.keyword == keyword else []
        out += every(n.children, keyword)
    return out


def name_and_expression(rest: str) -> tuple[str, str | None]:
    """``'quoted ''name''' = expression`` or a bare name."""
    m = re.match(r"\s*(?:'((?:[^']|'')*)'|([^=]*?))\s*(?:=\s*(.*))?$", rest, re.S)
    name = (m.group(1) or "").replace("''", "'") if m.group(1) is not None else (m.group(2) or "").strip()
    return name, m.group(3)


def properties(node: Node) -> dict[str, str]:
    return {c.keyword: c.rest.removeprefix(":").strip() for c in node.children if c.rest.startswith(":")}


def flags(node: Node) -> set[str]:
    return {c.keyword for c in node.children if not c.rest}


def table_column(text: str) -> tuple[str, str]:
    """``Table.Column``, either part in single quotes."""
    m = re.match(r"\s*(?:'((?:[^']|'')*)'|([^.']+))\.(?:'((?:[^']|'')*)'|(.+?))\s*$", text)
    return (m.group(1) or m.group(2)).replace("''", "'"), (m.group(3) or m.group(4)).replace("''", "'")


def from_tmdl(text: str, name: str | None = None, source_file: str | None = None) -> SemanticModel:
    roots = nodes(text)
    parameters = {}
    for n in every(roots, "expression"):
        key, e = name_and_expression(n.rest)
        if (v := parameter_value(e or n.text())) is not None:
            parameters[key] = v
    tables = []
    for i, t in enumerate(every(roots, "table")):
        columns, measures, levels, hints, auto, calculated = [], [], [], [], False, False
        for c in t.children:
            key, e = name_and_expression(c.rest)
            e = ((e or "") + "\n" + c.text()).strip() or None
            p = properties(c)
            if c.keyword == "column":
                columns.append(Column(key, p.get("dataType"), e, "isHidden" in flags(c) or p.get("isHidden") == "true", CONFIRMED, f"tables[{i}]"))
            elif c.keyword == "measure":
                measures.append(Measure(key, e or "", CONFIRMED if e else REQUIRES_INPUT, p.get("formatString"), None, f"tables[{i}]"))
            elif c.keyword == "hierarchy":
                levels.append((key, tuple(properties(x).get("column", name_and_expression(x.rest)[0]).strip("'") for x in every(c.children, "level"))))
            elif c.keyword == "annotation":
                auto |= key in AUTO_DATE and (e or "").lower() == "true"
            elif c.keyword == "partition":
                calculated |= (e or "").startswith("calculated")
                hints += [h for s in every([c], "source") if (h := source_hint(s.rest + "\n" + s.text(), parameters))]
        kind = "AUTO_DATE" if auto else "CALCULATED" if calculated else "CALCULATION_GROUP" if every([t], "calculationGroup") else "REGULAR"
        tables.append(Table(name_and_expression(t.rest)[0] or f"UnnamedTable{i}", None, tuple(columns), tuple(measures), kind, None, tuple(levels), hints[0] if hints else None))
    relationships = []
    for r in every(roots, "relationship"):
        p = properties(r)
        a, b = table_column(p["fromColumn"]), table_column(p["toColumn"])
        relationships.append(Relationship(*a, *b, cardinality(p.get("fromCardinality"), p.get("toCardinality")), direction(p.get("crossFilteringBehavior")), p.get("isActive", "true") != "false"))
    found = every(roots, "model")
    title = name or (name_and_expression(found[0].rest)[0] if found else "model")
    counted = {
        "roles": len(every(roots, "role")), "rls_filters": len(every(roots, "tablePermission")), "calculation_groups": len(every(roots, "calculationGroup")), "calculated_tables": sum(t.table_type == "CALCULATED" for t in tables),
        "hierarchies": len(every(roots, "hierarchy")), "perspectives": sum(n.depth <= 1 for n in every(roots, "perspective")), "cultures": len(every(roots, "cultureInfo")) + len(every(roots, "culture")),
        "calculated_columns": sum(c.expression is not None for t in tables for c in t.columns), "kpis": len(every(roots, "kpi")), "calculation_items": len(every(roots, "calculationItem")),
    }
    return labelled(SemanticModel(title, tuple(tables), tuple(relationships), counted | of_relationships(relationships), source_file))


def load(text: str, name: str | None = None, source_file: str | None = None) -> SemanticModel:
    """A model from a file's text, whatever its form."""
    shape = detect(text.removeprefix("﻿"))
    if shape == TMDL_MODEL:
        return from_tmdl(text, name, source_file)
    if shape == POWER_BI_MODEL:
        return from_json(text, name, source_file)
    raise InvalidModel(f"a file of shape {shape} holds no model")


def from_template(content: bytes, source_file: str | None = None) -> SemanticModel:
    """The model inside a report template (a ZIP file with the JSON form)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return from_json(z.read("DataModelSchema").decode("utf-16-le").lstrip("﻿"), source_file=source_file)


def load_folder(spark: SparkSession, folder: str) -> list[SemanticModel]:
    """The models below a folder: one for each JSON file, template and project folder, and one of all other text files together."""
    found = discover(spark, folder).where("skipped is null")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    rows = files.join(found, "path").select("path", "kind", "shape", "root", "content").collect()  # model files
    text = lambda r: bytes(r.content).decode("utf-8-sig")
    out, projects = [], {}
    for r in sorted(rows, key=lambda r: (not r.path.endswith("/model.tmdl"), not r.path.endswith("/database.tmdl"), r.path)):
        if r.kind == "project" or r.path.endswith(".tmdl"):
            projects.setdefault(r.root or folder, []).append(text(r))
        elif r.kind == "pbit":
            out.append(from_template(bytes(r.content), r.path))
        elif r.shape == POWER_BI_MODEL:
            out.append(from_json(text(r), source_file=r.path))
    return [*out, *[from_tmdl("\n".join(parts), source_file=root) for root, parts in projects.items()]]


# Words in import queries that tell the kind of a data source.
SOURCE_KINDS = {
    "Teradata.Database": "Teradata", "Sql.Database": "SQL Server / Azure SQL", "Sql.Databases": "SQL Server / Azure SQL", "Snowflake.Databases": "Snowflake", "Databricks.Catalogs": "Databricks",
    "DatabricksMultiCloud.Catalogs": "Databricks", "Oracle.Database": "Oracle", "PostgreSQL.Database": "PostgreSQL", "GoogleBigQuery.": "BigQuery", "AmazonRedshift.": "Redshift", "Odbc.": "ODBC", "OleDb.": "OLE DB",
    "AnalysisServices.": "Analysis Services", "PowerPlatform.Dataflows": "Dataflow", "PowerBI.Dataflows": "Dataflow", "Excel.Workbook": "Excel", "Csv.Document": "CSV", "SharePoint.": "SharePoint", "Web.Contents": "Web",
    "AzureStorage.": "Azure Storage", "Folder.Files": "Folder", "Json.Document": "JSON", "Binary.Decompress": "Entered data",
}
NO_SOURCE = "Other / none detected"


def source_kinds(query: SparkColumn) -> SparkColumn:
    """The kinds of sources that a query reads, sorted; one entry says so if none is known."""
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(query, F.lit(k)), v) for k, v in SOURCE_KINDS.items()]))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_SOURCE)))
