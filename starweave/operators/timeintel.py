"""Time intelligence over frames: month-keyed shifts, running and rolling totals, semi-additive values, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def calendar(spark: SparkSession, first: str = "2020-01-01", last: str = "2030-12-31", today: Column | None = None) -> DataFrame:
    """A date dimension with flags of the current periods and keys of the periods before."""
    now = today if today is not None else F.current_date()
    d = F.col("date_key")
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_key"))
    upto = d <= now
    return rows.select(
        "date_key", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "yyyy-MM").alias("year_month"), F.weekday(d).alias("weekday"),
        ((F.year(d) == F.year(now)) & upto).alias("is_current_ytd"), ((F.trunc(d, "quarter") == F.trunc(now, "quarter")) & upto).alias("is_current_qtd"), ((F.trunc(d, "month") == F.trunc(now, "month")) & upto).alias("is_current_mtd"),
        F.add_months(d, -12).alias("date_key_ly"), F.add_months(d, -3).alias("date_key_lq"), F.add_months(d, -1).alias("date_key_lm"),
    )


def shifted(rows: DataFrame, month: str, values: list[str], months: int, by: list[str] = (), suffix: str = "prior") -> DataFrame:
    """Values of the period ``months`` away, joined by key: gaps give null, and never another period's value."""
    other = rows.select(*by, F.add_months(month, -months).alias(month), *[F.col(v).alias(f"{v}_{suffix}") for v in values])
    return rows.join(other, [*by, month], "left")


def densified(rows: DataFrame, month: str, by: list[str] = ()) -> DataFrame:
    """A row for each month between a group's first and last."""
    spine = rows.groupBy(*by).agg(F.min(month).alias("_a"), F.max(month).alias("_b")).select(*by, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias(month))
    return spine.join(rows, [*by, month], "left")


def running(rows: DataFrame, month: str, value: str, period: str = "year", by: list[str] = (), name: str = "running") -> DataFrame:
    scope = {"year": [F.year(month)], "quarter": [F.year(month), F.quarter(month)], "month": [F.year(month), F.month(month)], "all": []}[period]
    w = Window.partitionBy(*by, *scope) if by or scope else Window.partitionBy(F.lit(0))
    return rows.withColumn(name, F.sum(value).over(w.orderBy(month).rowsBetween(Window.unboundedPreceding, 0)))


def window_measure(rows: DataFrame, order: str, value: str, aggregate=F.sum, trailing: int | None = None, leading: int | None = None, inclusive: bool = False, unit: str = "rows", offset: int = 0, semiadditive: str | None = None, by: list[str] = (), name: str = "value") -> DataFrame:
    """A declared window: ``trailing`` n periods leave the anchor out unless inclusive; ``unit`` is rows or months.

    ``semiadditive`` (first or last) takes one row's value of the frame instead of an aggregate; ``offset`` moves the anchor.
    """
    index = F.year(order) * 12 + F.month(order) if unit == "months" else F.col(order)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(index)
    if trailing is not None:
        low, high = (1 - trailing, 0) if inclusive else (-trailing, -1)
    elif leading is not None:
        low, high = (0, leading - 1) if inclusive else (1, leading)
    else:
        low, high = Window.unboundedPreceding, 0
    low, high = (low if low == Window.unboundedPreceding else low + offset), high + offset
    frame = w.rangeBetween(low, high) if unit == "months" else w.rowsBetween(low, high)
    pick = {"first": lambda: F.first(value, ignorenulls=True), "last": lambda: F.last(value, ignorenulls=True)}
    return rows.withColumn(name, (pick[semiadditive]() if semiadditive else aggregate(value)).over(frame))


def last_per_entity(rows: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """The latest row of each entity. ``order`` must be total. A combining aggregate: a frequent entity doesn't gather in one task."""
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*[F.col(f"`{o}`") for o in order])).alias("_best")
    return rows.groupBy(*[F.col(f"`{e}`") for e in entity]).agg(best).select("_best.*")


def balance(rows: DataFrame, entity: str, day: str, value: str, period: str = "month", tie: str | None = None, opening: bool = False) -> DataFrame:
    """Semi-additive: each entity's last (or first) known value of a period, then summed over entities.

    Two combining aggregations instead of a window: a frequent entity doesn't gather in one task.
    """
    key = F.struct(F.col(day), *([F.col(tie)] if tie else []))
    pick = F.min_by if opening else F.max_by
    per = rows.where(F.col(value).isNotNull()).groupBy(entity, F.trunc(F.col(day), period).alias("period")).agg(pick(value, key).alias("v"))
    return per.groupBy("period").agg(F.sum("v").alias("balance"), F.count(F.lit(1)).alias("entities"))


def carried(rows: DataFrame, entity: str, order: str, value: str, name: str = "carried") -> DataFrame:
    """The last known value up to each row.

    In two steps, so that a frequent entity doesn't gather in one task: ``order`` (numbers, dates or times, or a struct that begins with one) is cut at 200
    quantiles; values are carried inside each part, and into a part comes the last one of the entity's parts before.
    """
    inside = Window.partitionBy(entity, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = in_parts(rows, order).withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    ends = dealt.groupBy(F.col(entity).alias("_entity"), F.col("_part").alias("_of")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy("_entity").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    both = dealt.join(ends, dealt[entity].eqNullSafe(ends["_entity"]) & (F.col("_part") == F.col("_of")))
    return both.select(*[dealt[c] for c in rows.columns], F.coalesce("_inside", "_before").alias(name))


def in_parts(rows: DataFrame, order: str, n: int = 200) -> DataFrame:
    """``rows`` with ``_part``, the number of quantiles of ``order`` (of a struct's first field) that lie below; nulls come first."""
    kind, at = rows.schema[order].dataType, F.col(f"`{order}`")
    if isinstance(kind, StructType):
        at = at[kind.fieldNames()[0]]
    marks = rows.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 10 * n).alias("_marks"))  # one row
    below = F.coalesce(F.size(F.filter("_marks", lambda m: m < at)), F.lit(0))
    return rows.crossJoin(F.broadcast(marks)).withColumn("_part", F.when(at.isNull(), -1).otherwise(below)).drop("_marks")


def share_of(rows: DataFrame, value: str, within: list[str] = (), name: str = "share") -> DataFrame:
    """Of an additive value: its part of the total of the kept columns."""
    total = rows.groupBy(*within).agg(F.sum(value).alias("_total"))
    both = rows.join(total, list(within)) if within else rows.crossJoin(F.broadcast(total))
    return both.withColumn(name, F.try_divide(value, "_total")).drop("_total")
