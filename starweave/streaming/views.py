"""Measures of one table over a stream: tumbling windows with a watermark, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starweave.plans.dax import DaxError, parse
from starweave.plans.metricview import Context, MetricView, Plan, qualified


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet as a stream, with the schema that the files have."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not path.endswith("*") else folder)


def windowed(view: MetricView, rows: DataFrame, time: str, measures: list[str], dims: list[str] = (), width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Measures for each window and dimension; late rows count until the watermark passes."""
    fact = view.fact.name
    moment = lambda c: F.col(c).cast("timestamp") if c == time else F.col(c)  # noqa: E731  watermarks need a time zone
    named = rows.select(*[moment(c.name).alias(qualified(fact, c.name)) for c in view.fact.columns if c.name in rows.columns])
    plan = Plan()
    out = [(m, view.measure(parse(view.measures_by_name[m.lower()]), Context(), plan, (m.lower(),))) for m in measures]
    used: set[str] = set()
    leaves = []
    for alias, build, _, context, kind in plan.leaves.values():
        if kind.startswith("NESTED") or kind == "RANKX" or context != Context(filters=context.filters) or kind.startswith("DISTINCT"):
            raise DaxError(f"{kind} can't run over a stream")
        leaves.append(build(used).alias(alias))
    if used - {fact.lower()}:
        raise DaxError("a streamed view has one table")
    at = qualified(fact, time)
    keys = [F.col(qualified(fact, d)).alias(d) for d in dims]
    done = named.withWatermark(at, late).groupBy(F.window(at, width).alias("_w"), *keys).agg(*leaves)
    return done.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *dims, *[c.alias(m) for m, c in out])


def start(rows: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished windows to a Parquet folder, exactly once."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(folder)
