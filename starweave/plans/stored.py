"""Stored aggregates: partial results of a view's measures, written at a grain, that later queries are answered from.

``store`` writes the leaves of measures by any columns of the view's tables; ``MetricView.with_stored`` makes a view use it. A context is
answered from a stored aggregate if all columns of its dimensions, filters, date axis and distinct counts are stored, and
each leaf is: as it is, or without its filter if that is over stored columns. Others read the facts as before. Of
several that cover a context, the one with the fewest rows is taken.

The base filter isn't stored but applied when a query reads, so one aggregate serves views of different base filters. With ``by``, a date
column, files are parted by month and ``refresh`` writes anew only the months that hold changed days.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.model import identifier
from starweave.plans.dax import DaxError, Ref, parse
from starweave.plans.metricview import MERGE, Context, MetricView, Plan, qualified

PART = "_part"


def leaf_name(fact: str, signature: str, kind: str, filters: tuple) -> str:
    return f"leaf_{identifier(fact.lower(), signature, kind, repr(filters))}"


@dataclass(frozen=True)
class Stored:
    fact: str
    frame: DataFrame
    rows: int

    def has(self, columns: set[str]) -> bool:
        return columns <= set(self.frame.columns)

    def leaf(self, view: MetricView, sign: tuple, context: Context) -> Column | None:
        """A leaf merged from stored parts, or null if it can't be."""
        signature, kind, filters = sign
        own, whole = (leaf_name(self.fact, signature, kind, f) for f in (filters, ()))
        if self.has({own}):
            return MERGE[kind](F.col(own))
        if not self.has({whole, *view.column_names(filters)}):
            return None
        used: set = set()
        holds = view.holds(context, used)
        if any(not isinstance(u, str) for u in used):
            return None
        part = F.when(holds, F.col(whole))
        return MERGE[kind](part.otherwise(0) if kind in ("COUNTBLANK", "HASBLANK") else part)


def _ref(text: str) -> Ref:
    node = parse(text)
    if not isinstance(node, Ref) or node.table is None:
        raise DaxError(f"not a column with its table: {text}")
    return node


def _aggregated(view: MetricView, columns: Sequence[str], measures: Sequence[str], by: str | None, months: DataFrame | None = None) -> DataFrame:
    if view.join != "left" or view.joins:
        raise DaxError("only views of left joins have stored aggregates")
    view = copy.copy(view)
    view.root, view.homes, view.stored, view.in_parts_only = view, {}, [], True
    plan, used = Plan(), set()
    for m in measures:
        view.measure(parse(view.measures_by_name[m.lower()]), Context(), plan, (m.lower(),))
    found = {}
    for (signature, *_), (_, build, _, c, kind) in plan.leaves.items():
        if kind in MERGE and c.home is None and not (c.role or c.semi or c.cross):
            found[leaf_name(view.fact.name, signature, kind, c.filters)] = build(used)
    keys = [_ref(c) for c in dict.fromkeys([*columns, *([by] if by else [])])]
    used |= {k.table.lower() for k in keys}
    rows = view.frame(used, inward=True)
    names = list(dict.fromkeys(qualified(k.table, k.name) for k in keys))
    part = F.trunc(F.col(qualified(_ref(by).table, _ref(by).name)).cast("date"), "month") if by else F.lit(None).cast("date")
    rows = rows.withColumn(PART, part)
    if months is not None:
        rows = rows.join(months.withColumnRenamed(PART, "_m"), F.col(PART).eqNullSafe(F.col("_m")), "left_semi")
    return rows.groupBy(PART, *names).agg(*[c.alias(n) for n, c in found.items()], F.count(F.lit(1)).alias("_rows"))


def store(view: MetricView, path: str, columns: Sequence[str], measures: Sequence[str], by: str | None = None) -> None:
    """Writes the parts of ``measures`` by ``columns`` (texts ``table[column]``), and by the date column ``by``."""
    _aggregated(view, columns, measures, by).write.mode("errorifexists").partitionBy(PART).parquet(path)


def refresh(view: MetricView, path: str, columns: Sequence[str], measures: Sequence[str], by: str, changed: DataFrame) -> None:
    """Writes anew the months that hold the days of ``changed`` (one date column; null: rows without a day). Other files stay as they are.

    Where the facts are parted by that date, only those parts are read. A month that has lost all its rows keeps one row that counts none.
    """
    months = changed.select(F.trunc(F.col(f"`{changed.columns[0]}`").cast("date"), "month").alias(PART)).distinct()
    new = _aggregated(view, columns, measures, by, months)
    lost = months.join(new.select(F.col(PART).alias("_m")).distinct(), F.col(PART).eqNullSafe(F.col("_m")), "left_anti").withColumn("_rows", F.lit(0).cast("long"))
    both = new.unionByName(lost, allowMissingColumns=True)
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def opened(spark: SparkSession, path: str, fact: str) -> Stored:
    """To be opened again after a refresh. The number of rows comes from the files' footers."""
    frame = spark.read.parquet(path)
    return Stored(fact, frame.where("_rows > 0").drop(PART), frame.count())
