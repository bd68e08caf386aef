"""Analysis of any number of models whose catalogs are frames, as ``model.frames`` gives them or as read from a metadata store.

Expressions are read in Arrow batches, one row of traits and references each; all that compares rows (resolution, dependencies,
scores, cycles, levels) are joins on (model, name) and aggregates. Nothing of the estate is held by the driver.

Names are compared without regard to letter case. A null expression refers to nothing and scores as a text that doesn't parse; a
measure whose name or model is null takes no part. Of measures of one name in a model the last by (name, table) is meant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.operators import scoring
from starweave.operators.lineage import components, levels
from starweave.plans.dax import Call, DaxError, TableRef, parse, references, tokens, walk

TRAITS = "model string, table string, name string, functions array<string>, filter_kinds array<string>, uses_var boolean, virtual_iterator boolean, blank_sensitive boolean, parses boolean, iterated array<string>, refs array<struct<table:string,name:string>>"


@dataclass(frozen=True)
class Estate:
    tables: DataFrame  # model, name
    columns: DataFrame  # model, table, name
    measures: DataFrame  # model, table, name, expression
    relationships: DataFrame  # model, from_table, to_table, cardinality, cross_filter, is_active


@lru_cache(maxsize=10_000)
def _of_shape(found: tuple[tuple[str, str], ...]) -> dict:
    """What no name in brackets changes: all but the references. Expressions of one shape are analysed once by a worker."""
    try:
        tree = parse("", list(found))
    except DaxError:
        tree = None
    iterated = sorted({n.args[0].name.lower() for n in walk(tree) if isinstance(n, Call) and n.args and isinstance(n.args[0], TableRef)})
    return scoring.analysis("", list(found), tree) | {"iterated": iterated}


def traits_of(expression: str | None) -> dict:
    try:
        found = tokens(expression or "")
    except DaxError:
        return {"functions": [], "filter_kinds": [], "uses_var": False, "virtual_iterator": False, "blank_sensitive": False, "parses": False, "iterated": [], "refs": []}
    qualified, bare = references("", found)
    refs = [{"table": t, "name": n} for t, n in qualified] + [{"table": None, "name": n} for n in bare]
    return _of_shape(tuple(("bracket", "[x]") if kind == "bracket" else (kind, value) for kind, value in found)) | {"refs": refs}


def traits(measures: DataFrame) -> DataFrame:
    """One row of functions, filter kinds, flags and references for each measure."""
    names = [c.strip().split(" ")[0] for c in TRAITS.split(", ")]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [{"model": m, "table": t, "name": n, **traits_of(e)} for m, t, n, e in zip(p["model"], p["table"], p["name"], p["expression"], strict=True)]
            yield pd.DataFrame(found, columns=names)

    rows = measures.where("model is not null and name is not null").select("model", "table", "name", "expression")
    return rows.mapInPandas(batches, TRAITS)


def references_of(estate: Estate, found: DataFrame) -> DataFrame:
    """(model, home, measure, reference, kind, target, reason): every reference resolved, or why it isn't.

    A bare name is another measure, else a column of the home table, else the only column of that name (or the only one among iterated
    tables). A qualified one is a column of its table, else a measure that lives there.
    """
    refs = found.select("model", F.col("table").alias("home"), F.col("name").alias("measure"), "iterated", F.explode("refs").alias("r"))
    refs = refs.select("*", F.col("r.table").alias("t"), F.col("r.name").alias("n"), F.lower("r.table").alias("lt"), F.lower("r.name").alias("ln")).drop("r")
    known = estate.measures.groupBy("model", F.lower("name").alias("ln")).agg(F.max(F.struct("name", "table")).alias("known"))
    tables = estate.tables.groupBy("model", F.lower("name").alias("lt")).agg(F.max("name").alias("owner"))
    one = estate.columns.groupBy("model", F.lower("table").alias("lt"), F.lower("name").alias("ln")).agg(F.max(F.struct("table", "name")).alias("column"))
    owners = estate.columns.groupBy("model", F.lower("name").alias("ln")).agg(F.array_sort(F.collect_set("table")).alias("owners"))  # a model's tables at most
    rows = refs.join(known, ["model", "ln"], "left")
    # qualified
    q = rows.where("t is not null").join(tables, ["model", "lt"], "left").join(one, ["model", "lt", "ln"], "left")
    named = lambda table, name: F.concat(table, F.lit("["), name, F.lit("]"))
    there = F.lower("known.table") == F.col("lt")
    kind = F.when(F.col("owner").isNull(), None).when(F.col("column").isNotNull(), "COLUMN").when(there, "MEASURE")
    q = q.select(
        "model", "home", "measure", named(F.coalesce("owner", "t"), F.col("n")).alias("reference"), kind.alias("kind"),
        F.when(kind == "COLUMN", named(F.col("column.table"), F.col("column.name"))).when(kind == "MEASURE", F.col("known.name")).alias("target"),
        F.when(F.col("owner").isNull(), "unknown table").when(kind.isNull(), "unknown column").alias("reason"),
    )
    # bare
    b = rows.where("t is null").join(owners, ["model", "ln"], "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
    here = F.filter("owners", lambda o: F.array_contains("iterated", F.lower(o)))
    own = F.array_contains("owners", F.col("home"))
    measure = F.col("known").isNotNull() & (F.col("ln") != F.lower("measure"))
    only = F.when(own, F.col("home")).when(F.size(here) == 1, F.get(here, F.lit(0))).when(F.size("owners") == 1, F.get("owners", F.lit(0)))
    kind = F.when(measure, "MEASURE").when(only.isNotNull(), "COLUMN")
    b = b.select(
        "model", "home", "measure", named(F.lit(""), F.col("n")).alias("reference"), kind.alias("kind"),
        F.when(measure, F.col("known.name")).when(only.isNotNull(), named(only, F.col("n"))).alias("target"),
        F.when(kind.isNull(), F.when(F.size("owners") > 0, F.concat(F.lit("ambiguous: columns of "), F.array_join("owners", ", "))).otherwise("unknown measure or column")).alias("reason"),
    )
    return q.unionByName(b).distinct()


def dependencies(refs: DataFrame) -> DataFrame:
    """Edges (src, dst) from measures to the measures that they refer to."""
    key = lambda c: F.concat_ws("\x1f", "model", c)
    return refs.where("kind = 'MEASURE'").select(key("measure").alias("src"), key("target").alias("dst")).distinct()


def classify(estate: Estate) -> DataFrame:
    """As ``scoring.classify``, over an estate: one row for each measure.

    A measure scores no more than what it refers to; members of a cycle score 20 at most.
    """
    found = scoring.settled(traits(estate.measures), parts=None)  # expressions are read once
    refs = scoring.settled(references_of(estate, found), parts=None)
    name = ["model", "table", "name"]
    used = refs.groupBy("model", F.col("home").alias("table"), F.col("measure").alias("name")).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "MEASURE", F.col("target")))).alias("measures"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "COLUMN", F.regexp_extract("target", r"^(.*?)\[", 1)))).alias("tables"),
    )
    rows = found.join(used, name, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("measures", "tables")})
    key = F.concat_ws("\x1f", "model", "name")
    own = scoring.settled(scoring.scored(rows, estate.relationships).withColumn("key", key), parts=None)
    edges = dependencies(refs)
    knots = components(edges)  # first, since cycles lower the scores that are handed on
    own = own.join(knots.select(F.col("node").alias("key"), F.lit(True).alias("cyclic")), "key", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    own = scoring.settled(own.withColumn("own_score", F.when(F.col("cyclic"), F.least("own_score", F.lit(20))).otherwise(F.col("own_score"))), parts=None)
    below = levels(edges, own.groupBy(F.col("key").alias("node")).agg(F.min("own_score").alias("value")), knots).select(F.col("node").alias("key"), "depth", "least")
    rows = own.join(below, "key", "left").withColumn("score", F.least("own_score", "least"))
    b = scoring.band(F.col("score"))
    return rows.select("model", "table", "name", "score", b.alias("band"), scoring.bucket(b).alias("bucket"), scoring.category().alias("category"), F.coalesce("depth", F.lit(0)).alias("depth"), "cyclic", "functions", "measures", "tables", "reasons")
