"""Checks of data against a model, and parity of figures with another system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave.functions.scalar import to_day, to_number
from starweave.model import SemanticModel, spark_type
from starweave.plans.dax import snake

# Shapes of numbers and dates in text, the share of values that must have it, parity tolerances.
NUMERIC = r"^\s*-?\$?\s*\d{1,3}(,\d{3})*(\.\d+)?\s*%?\s*$|^\s*-?\d+(\.\d+)?\s*$"
DATELIKE, SHARE = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?\s*$|^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$", 0.8
ABSOLUTE, RELATIVE = 0.01, 1e-4


def fan_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: a join on them would multiply rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cardinality(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: rows, distinct keys, duplicate keys. Counted through a grouping, so partial sums combine before the exchange."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_duplicated"))


def orphans(facts: DataFrame, key: str, dimension: DataFrame, other: str) -> DataFrame:
    """Facts whose key no dimension row has (null keys are counted apart)."""
    return facts.where(F.col(key).isNotNull()).join(dimension.select(F.col(other).alias(key)), key, "left_anti")


def null_density(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, n_rows, n_null, share) in one pass."""
    names = columns or tuple(rows.columns)
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in names])
    return one.select("_n", F.inline(pairs)).select("column", F.col("_n").alias("n_rows"), "n_null", F.try_divide("n_null", "_n").alias("share"))


def type_mix(rows: DataFrame, column: str) -> DataFrame:
    kind = F.when(F.col(column).isNull(), "null").when(F.col(column).cast("string").rlike(NUMERIC), "number").when(F.col(column).cast("string").rlike(DATELIKE), "date").otherwise("text")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def date_coverage(facts: DataFrame, day: str, calendar: DataFrame, other: str) -> DataFrame:
    """One row: whether all fact dates lie within the calendar, and how many don't."""
    bounds = calendar.agg(F.min(other).alias("first_day"), F.max(other).alias("last_day"))
    d = F.col(day).cast("date")
    return facts.select(d.alias("d")).crossJoin(F.broadcast(bounds)).groupBy("first_day", "last_day").agg(F.min("d").alias("first_fact"), F.max("d").alias("last_fact"), F.count_if(~F.col("d").between(F.col("first_day"), F.col("last_day"))).alias("n_outside")).withColumn("covered", F.col("n_outside") == 0)


def looks(c: Column, pattern: str) -> Column:
    """An aggregate: whether enough non-empty values have the shape."""
    filled = F.when(F.trim(c) != "", c)
    return F.coalesce(F.avg(filled.rlike(pattern).cast("double")) >= SHARE, F.lit(False))


def text_flags(rows: DataFrame) -> DataFrame:
    """(column, issue, fix) of text columns that hold numbers or dates, over all rows in one pass."""
    names = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    if not names:
        return rows.sparkSession.createDataFrame([], "column string, issue string, fix string")
    one = rows.agg(*[F.struct(looks(F.col(c), NUMERIC).alias("number"), looks(F.col(c), DATELIKE).alias("date")).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(f"{c}.number"), "varchar_numeric").when(F.col(f"{c}.date"), "string_date").alias("issue"), F.when(F.col(f"{c}.number"), f"try_cast({c} AS DOUBLE)").when(F.col(f"{c}.date"), f"to_date({c})").alias("fix")) for c in names])
    return one.select(F.inline(pairs)).where("issue is not null")


def cleaned(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Columns flagged by ``text_flags`` as what they hold."""
    return rows.withColumns({c: to_number(F.col(c)) if issue == "varchar_numeric" else to_day(F.col(c)) for c, issue in flags.items()})


def matched_tables(model: DataFrame, catalog: DataFrame, seeds: dict[str, str] | None = None) -> DataFrame:
    """(name, physical, how): a table's physical one by seed, by its normalised name, or by one name containing the other.

    ``model`` has names, ``catalog`` physical names like a.b.c; both are metadata.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"\W+|_+", "_")))
    left = model.select("name", norm(F.col("name")).alias("k"))
    right = catalog.select("physical", norm(F.element_at(F.split("physical", "\\."), -1)).alias("p"))
    seeded = F.lit(None).cast("string")
    for name, physical in (seeds or {}).items():
        seeded = F.when(F.col("name") == name, physical).otherwise(seeded)
    # one name contains another if it has the other among its substrings: an equi-join on these (names are short)
    parts = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substr(c, i, n)))))
    inside = left.select("name", "k", F.explode(parts(F.col("k"))).alias("p")).join(right, "p")
    around = right.select("physical", "p", F.explode(parts(F.col("p"))).alias("k")).join(left, "k")
    pairs = inside.select("name", "k", "physical", "p").unionByName(around.select("name", "k", "physical", "p")).dropDuplicates(["name", "physical"]).where("k != '' and p != ''")
    ranked = pairs.withColumn("rank", F.when(F.col("k") == F.col("p"), 1).otherwise(2))
    best = Window.partitionBy("name").orderBy("rank", F.abs(F.length("k") - F.length("p")), "physical")
    best_rows = ranked.withColumn("i", F.row_number().over(best)).where("i = 1").select("name", "physical", "rank")
    out = left.join(best_rows, "name", "left").withColumn("seed", seeded)
    how = F.when(F.col("seed").isNotNull(), "seed").when(F.col("rank") == 1, "exact").when(F.col("rank") == 2, "contains").otherwise("none")
    return out.select("name", F.coalesce("seed", "physical").alias("physical"), how.alias("how"))


def reconcile_columns(model: SemanticModel, table: str, rows: DataFrame) -> DataFrame:
    """(column, model_type, physical_type, verdict) for a model table against a frame's schema, on normalised names."""
    spark = rows.sparkSession
    left = spark.createDataFrame([(snake(c.name), c.name, spark_type(c.data_type)) for c in model.table(table).columns if not c.expression], "k string, column string, model_type string")
    right = spark.createDataFrame([(snake(f.name), f.dataType.simpleString()) for f in rows.schema], "k string, physical_type string")
    family = lambda c: F.regexp_extract(c, "^(decimal|bigint|int|smallint|tinyint|double|float|string|varchar|date|timestamp|boolean|binary)", 1)
    group = lambda c: F.when(family(c).isin("bigint", "int", "smallint", "tinyint"), "integer").when(family(c).isin("double", "float", "decimal"), "number").when(family(c).isin("date", "timestamp"), "time").when(family(c).isin("string", "varchar"), "text").otherwise(family(c))
    both = left.join(right, "k", "left")
    verdict = F.when(F.col("physical_type").isNull(), "missing").when(group(F.col("model_type")) == group(F.col("physical_type")), "ok").otherwise("type differs")
    return both.select("column", "model_type", "physical_type", verdict.alias("verdict"))


def gap_severity(found: DataFrame) -> DataFrame:
    """Adds a severity to rows with columns how (of a table match) and verdict (of a column)."""
    return found.withColumn("severity", F.when(F.col("how") == "none", "BLOCKER").when(F.col("verdict") == "missing", "HIGH").when(F.col("verdict") == "type differs", "MEDIUM"))


# --- parity


def close(a: Column, b: Column) -> Column:
    """Both null, or near by either tolerance."""
    near = (F.abs(a - b) <= ABSOLUTE) | (F.abs(a - b) <= RELATIVE * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def parity(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison by keys (nulls are equal): both values, which side is missing, and whether they match."""
    a = ours.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.col(value).cast("double").alias("ours"), F.lit(True).alias("in_ours"))
    b = theirs.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(value).cast("double").alias("theirs"), F.lit(True).alias("in_theirs"))
    on = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    both = a.join(b, on, "full_outer") if keys else a.crossJoin(b)
    matches = F.col("in_ours").isNotNull() & F.col("in_theirs").isNotNull() & close(F.col("ours"), F.col("theirs"))
    return both.select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], "ours", "theirs", F.coalesce("in_ours", F.lit(False)).alias("in_ours"), F.coalesce("in_theirs", F.lit(False)).alias("in_theirs"), matches.alias("matches"))


def first_differences(compared: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    return compared.where("not matches").orderBy(*keys).limit(n)


def rescored(scores: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores after parity: agreement lifts a measure to 95 (80 if it was below 40), disagreement caps it at 40."""
    both = scores.join(verdicts.groupBy("name").agg(F.min(F.col("matches").cast("int")).alias("ok")), "name", "left")
    score = F.when(F.col("ok") == 1, F.greatest("score", F.when(F.col("score") >= 40, 95).otherwise(80))).when(F.col("ok") == 0, F.least("score", F.lit(40))).otherwise(F.col("score"))
    return both.withColumn("score", score).drop("ok")


def coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change): names that a stage dropped or added, repeats counted."""
    gone = before.select("name").exceptAll(after.select("name")).withColumn("change", F.lit("dropped"))
    new = after.select("name").exceptAll(before.select("name")).withColumn("change", F.lit("extra"))
    return gone.unionByName(new)


def fidelity(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Expressions by name, white space apart: same, altered, dropped or extra."""
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    a, b = truth.select("name", norm(F.col("expression")).alias("a")), found.select("name", norm(F.col("expression")).alias("b"))
    state = F.when(F.col("b").isNull(), "dropped").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("altered")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


def edge_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: edges of the truth, how many were found, and extra ones; names compared without case."""
    norm = lambda df: df.select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct()
    t, f = norm(truth), norm(found)
    hit = t.intersect(f).agg(F.count("*").alias("n_found"))
    return t.agg(F.count("*").alias("n_truth")).crossJoin(hit).crossJoin(f.exceptAll(t).agg(F.count("*").alias("n_extra"))).withColumn("recall", F.try_divide("n_found", "n_truth"))


def property_agreement(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Relationships whose cardinality, direction or activity differ, each once."""
    keys = ["from_table", "from_column", "to_table", "to_column"]
    props = ["cardinality", "cross_filter", "is_active"]
    both = truth.select(*keys, *[F.col(p).alias(f"t_{p}") for p in props]).join(found.select(*keys, *props), keys)
    wrong = F.array_compact(F.array(*[F.when(F.col(f"t_{p}") != F.col(p), p) for p in props]))
    return both.select(*keys, wrong.alias("differs")).where(F.size("differs") > 0)


def redacted(rows: DataFrame, salt: str, *columns: str) -> DataFrame:
    """Names replaced by salted digests; models by stable aliases."""
    out = rows.withColumns({c: F.substring(F.sha2(F.concat(F.lit(salt), F.col(c)), 256), 1, 12) for c in columns})
    return out.withColumn("model", F.concat(F.lit("model_"), F.dense_rank().over(Window.orderBy("model")))) if "model" in out.columns else out


def change_request(translations: DataFrame, edits: DataFrame) -> DataFrame:
    """Translations (name, sql, status) under reviewed edits (name, new_sql, drop)."""
    both = translations.join(edits, "name", "left")
    status = F.when(F.coalesce("drop", F.lit(False)), "dropped").when(F.col("new_sql").isNotNull(), "reviewed").otherwise(F.col("status"))
    return both.select("name", F.coalesce("new_sql", "sql").alias("sql"), status.alias("status"))


# Weights of review findings.
SEVERITY = {"CRITICAL": 25, "HIGH": 10, "MEDIUM": 4, "LOW": 1}


def review(findings: DataFrame) -> DataFrame:
    """One row: score and verdict of findings (finding, severity, object)."""
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in SEVERITY.items()], F.lit(0))
    one = findings.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum(weight), F.lit(0))).cast("int").alias("score"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count(F.lit(1)).alias("n"))
    verdict = F.when((F.col("score") >= 90) & (F.col("critical") == 0), "APPROVE").when((F.col("score") >= 70) & (F.col("critical") == 0), "APPROVE_WITH_CONDITIONS").otherwise("REJECT")
    return one.withColumn("verdict", verdict)


def ranked_findings(findings: DataFrame) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("severity") == s, k) for k, s in enumerate(SEVERITY)], F.lit(9))
    return findings.orderBy(order, "finding", "object")


def scorecard(rows: DataFrame) -> DataFrame:
    """Counters (columns expected, found) summed over a corpus, with their ratio."""
    return rows.groupBy("counter").agg(F.sum("expected").alias("expected"), F.sum("found").alias("found")).withColumn("ratio", F.try_divide("found", "expected"))


# --- bridges and filter directions


def through_bridge(facts: DataFrame, fact_key: str, bridge: DataFrame, near: str, far: str, wanted: DataFrame, key: str) -> DataFrame:
    """Facts that a many-to-many bridge ties to any wanted key; no fact is repeated."""
    keys = bridge.join(wanted.select(F.col(key).alias(far)), far, "left_semi").select(F.col(near).alias(fact_key)).distinct()
    return facts.join(keys, fact_key, "left_semi")


def filtered_dimension(dimension: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """Dimension rows that facts use: the filter of a bidirectional relationship."""
    return dimension.join(facts.select(F.col(fact_key).alias(key)), key, "left_semi")
