"""Lint of a view and of its translations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave.operators.scoring import analyse
from starweave.plans.dax import Call, DaxError, parse, snake, to_sql, walk
from starweave.plans.metricview import MetricView, Plan
from starweave.plans.metricview import Context as _Context

FINDINGS = "finding string, severity string, object string, message string"
#: Functions whose SQL namesake means something else.
RISKY = {"INT": "truncates or floors", "LOG": "base and argument order", "WEEKDAY": "first day and numbering", "TRIM": "inner spaces", "MIN": "two arguments", "MAX": "two arguments"}
#: Functions that rewrite a join key.
KEY_FUNCTIONS = ["cast", "to_date", "trim", "upper", "lower", "substr"]


@dataclass(frozen=True)
class Rule:
    """A finding about each row of a part of the specification for which ``wrong`` holds."""

    finding: str
    severity: str
    part: str
    message: str
    wrong: Callable[[], Column]


def _has(*words: str) -> Column:
    return F.arrays_overlap("words", F.lit([*words]))


# Ids and severities of the rules.
RULES = (
    Rule("A4", "HIGH", "join", "a function in a join predicate", lambda: _has(*KEY_FUNCTIONS) & _has("(")),
    Rule("A6", "MEDIUM", "dimension", "dimensions name is repeated", lambda: F.col("repeats") > 1),
    Rule("A6", "MEDIUM", "measure", "measures name is repeated", lambda: F.col("repeats") > 1),
    Rule("B1", "HIGH", "measure", "no provenance", lambda: F.col("dax") == ""),
    Rule("B2", "CRITICAL", "measure", "window or subquery inside a measure", lambda: _has("over", "select")),
    Rule("B3", "HIGH", "measure", "division without a guard", lambda: _has("/") & ~_has("try_divide")),
    Rule("B5", "HIGH", "measure", "a filter was dropped", lambda: F.array_contains("functions", "CALCULATE") & ~_has("filter", "where")),
    Rule("B9", "CRITICAL", "measure", "an unreviewed marker", lambda: F.size(F.array_intersect("notes", F.lit(["REVIEW", "CANDIDATE", "TODO"]))) > 0),
    Rule("B10", "HIGH", "measure", "a reference to another measure is unresolved", lambda: F.size(F.array_except(F.array_intersect("brackets", "every"), F.array("name"))) > 0),
    Rule("B11", "CRITICAL", "measure", "a column that holds numbers as text", lambda: F.size(F.array_except(F.array_intersect("words", "texts"), "casts")) > 0),
    Rule("C2", "CRITICAL", "measure", "figures differ", lambda: F.col("agrees") == F.lit(False)),
    Rule("G3", "CRITICAL", "measure", "a measure of this band is in the view", lambda: F.col("band").isin("MANUAL_PORT", "UNSUPPORTED")),
    Rule("A1", "CRITICAL", "key", "a key is missing", lambda: F.col("text") == ""),
    Rule("A1", "HIGH", "version", "version is not 1.1", lambda: F.col("text") != "1.1"),
    Rule("C4", "HIGH", "feature", "needs a decision", lambda: F.col("text") != "0"),
    Rule("A2", "MEDIUM", "relationship", "an active relationship has no join", lambda: F.col("text") == ""),
    Rule("A5", "CRITICAL", "grain", "the joins' grain was never checked", lambda: F.col("text") == "unknown"),
    Rule("A5", "HIGH", "grain", "a join multiplies rows", lambda: F.col("text").try_cast("long") > 0),
    Rule("A8", "HIGH", "syntax", "the view's syntax was never tried", lambda: F.col("text") == "unknown"),
    Rule("A9", "CRITICAL", "table", "no physical table is known", lambda: F.col("text") == ""),
    Rule("A9", "CRITICAL", "profile", "tables and types were never compared with the catalog", lambda: F.col("text") == "missing"),
    Rule("A9", "HIGH", "profile", "tables were matched by name alone", lambda: F.col("text") == "unscanned"),
)


def parts_of(spec: dict, features: dict, evidence: dict | None) -> list[tuple[str, str, str, str, list[str]]]:
    """Rows (part, name, text, dax, functions of the DAX) of all that the rules look at."""
    keys = [("key", "spec", str(spec.get(k, "")), "", []) for k in ("version", "source", "measures")]
    out = [*keys, ("version", "spec", str(spec.get("version")), "", [])]
    out += [("join", j.get("name"), str(j.get("on", "")), "", []) for j in spec.get("joins") or []]
    out += [("dimension", d.get("name"), str(d.get("expr", "")), "", []) for d in spec.get("dimensions") or []]
    for m in spec.get("measures") or []:
        text = m.get("expr") or ""
        dax = m.get("source_dax") or text.partition("-- DAX:")[2].strip()
        out.append(("measure", m["name"], text, dax, analyse(dax)["functions"] if dax else []))
    out += [("feature", f, str(int(bool(n))), "", []) for f, n in features.items() if f in ("calculation_groups", "bidirectional", "many_to_many", "roles")]
    if evidence is not None:
        sources = {j.get("source") for j in spec.get("joins") or []}
        out += [("relationship", t, t if physical in sources else "", "", []) for t, physical in (evidence.get("joined") or {}).items()]
        out += [("grain", k, str(n), "", []) for k, n in (evidence.get("grain") or {"joins": "unknown"}).items()]
        out.append(("syntax", "view", "tried" if evidence.get("syntax") else "unknown", "", []))
        profile = evidence.get("profile")
        out.append(("profile", "profile", "missing" if profile is None else "scanned" if evidence.get("scanned") else "unscanned", "", []))
        out += [("table", t, physical or "", "", []) for t, physical in (profile or {}).items()]
    return out


def lint(
    spark: SparkSession, spec: dict, varchar_numeric: set[str] = frozenset(), bands: dict[str, str] | None = None, parity: dict[str, bool] | None = None, features: dict | None = None, evidence: dict | None = None
) -> DataFrame:
    """Findings for a view in its YAML form: structure, joins, measures, parity and open decisions.

    ``evidence`` adds what was checked outside of the specification: ``joined`` (table of an active relationship -> physical table),
    ``grain`` (join -> keys that occur more than once), ``syntax`` (tried or not), ``profile`` (table -> physical table or None)
    and ``scanned`` (whether a catalog was read). Without it those rules are left out; with an empty one all is open.
    """
    rows = spark.createDataFrame(parts_of(spec, features or {}, evidence), "part string, name string, text string, dax string, functions array<string>")
    body = F.regexp_replace("text", r"--[^\n]*", "")
    rows = rows.select(
        "*", F.regexp_extract_all(F.lower(body), F.lit(r"[a-z_][a-z_0-9]*|[^\sa-z_0-9]"), F.lit(0)).alias("words"), F.regexp_extract_all("text", F.lit(r"-- (\w+)"), F.lit(1)).alias("notes"),
        F.regexp_extract_all(body, F.lit(r"\[([^\]]+)\]"), F.lit(1)).alias("brackets"), F.regexp_extract_all(F.lower(body), F.lit(r"try_cast\s*\(\s*([a-z_0-9.]+)"), F.lit(1)).alias("casts"),
        F.lit(sorted(c.lower() for c in varchar_numeric)).cast("array<string>").alias("texts"), F.count(F.lit(1)).over(Window.partitionBy("part", "name")).alias("repeats"),
        F.collect_set(F.when(F.col("part") == "measure", F.col("name"))).over(Window.partitionBy("part")).alias("every"),
    )
    told = spark.createDataFrame([(n, (bands or {}).get(n), (parity or {}).get(n)) for n in {*(bands or {}), *(parity or {})}], "name string, band string, agrees boolean")
    rows = rows.join(told, "name", "left")
    found = F.array_compact(F.array(*[F.when((F.col("part") == r.part) & r.wrong(), F.struct(F.lit(r.finding).alias("finding"), F.lit(r.severity).alias("severity"), F.col("name").alias("object"), F.lit(r.message).alias("message"))) for r in RULES]))
    return rows.select(F.inline(found)).distinct()


#: Functions of the measure language that no SQL of a translation may hold.
RESIDUE = sorted({"CALCULATE", "FILTER", "ALL", "ALLEXCEPT", "REMOVEFILTERS", "KEEPFILTERS", "DIVIDE", "COUNTROWS", "RELATED", "SUMX", "AVERAGEX", "ISBLANK", "BLANK", "SWITCH", "DISTINCTCOUNT", "TREATAS", "SELECTEDVALUE"})


def sql_risks(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(name, risk, why) of translations (name, dax, sql): leftover functions and brackets, operators, functions of another meaning.

    Literals are blanked on both sides first.
    """
    plain = lambda c, quote: F.regexp_replace(c, f"{quote}[^{quote}]*{quote}", quote * 2)
    rows = pairs.select("name", plain(F.col("dax"), '"').alias("dax"), plain(F.col("sql"), "'").alias("sql"))
    calls = F.transform(F.regexp_extract_all("sql", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)), F.upper)
    left = F.array_intersect(calls, F.lit([f for f in RESIDUE if f != "FILTER"]))
    count = lambda c, text: F.regexp_count(c, F.lit(text))
    single = r"(?<!&)&(?!&)"
    risk = lambda kind, test, why: F.when(test, F.struct(F.lit(kind).alias("risk"), why.alias("why")))
    found = [
        risk("dax_residue", F.size(left) > 0, F.concat(F.lit("left over: "), F.array_join(F.array_sort(left), ", "))),
        risk("dax_residue", F.col("sql").rlike(r"\[[^\]]*\]"), F.lit("a reference in brackets")),
        risk("operator", F.contains("sql", F.lit("&&")), F.lit("&& is no SQL")),
        risk("operator", count("sql", single) > 0, F.lit("& is a bitwise operator in SQL")),
        risk("operator", F.contains("dax", F.lit("||")) & (count("sql", r"\|\|") > count("dax", single)), F.lit("|| joins strings in SQL")),
        *[risk("meaning", F.array_contains(calls, f), F.lit(f"{f}: {why}")) for f, why in RISKY.items() if f not in ("MIN", "MAX")],
        risk("meaning", F.col("sql").rlike(r"(?i)\b(min|max)\s*\([^(),]+,[^(),]+\)"), F.lit("MIN, MAX: two arguments")),
    ]
    return rows.select("name", F.inline(F.array_compact(F.array(*found))))


def translation_risks(expression: str) -> list[str]:
    """Functions in an expression whose translation by name alone would be wrong."""
    try:
        found = [n for n in walk(parse(expression)) if isinstance(n, Call)]
    except DaxError as e:
        return [f"doesn't parse: {e}"]
    return sorted({f"{n.name}: {RISKY[n.name]}" for n in found if n.name in RISKY and (n.name not in ("MIN", "MAX") or len(n.args) > 1)})


def translations(spark: SparkSession, view: MetricView) -> DataFrame:
    """(name, dax, sql, status, reason, risks): every measure as SQL text where one aggregate expression has it.

    status: auto (SQL text), engine (runs here, but has no form as one expression), unsupported (with the reason).
    """
    rows = []
    for name, dax in view.measures_by_name.items():
        try:
            view.measure(parse(dax), _Context(), Plan(), (name,))
            status, reason = "engine", None
            try:
                sql, status = to_sql(parse(dax), view.fact.name), "auto"
            except DaxError as e:
                sql, reason = None, str(e)
        except DaxError as e:
            sql, status, reason = None, "unsupported", str(e)
        rows.append((name, snake(name), dax, sql, status, reason, translation_risks(dax)))
    return spark.createDataFrame(rows, "name string, identifier string, dax string, sql string, status string, reason string, risks array<string>")
