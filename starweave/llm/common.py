"""Shared plumbing: reading tables, keys that survive nulls and repeats, cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator: such a document comes after every other one.
NULL_ID = 2**63 - 1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``_id`` (null ids last), ``_text`` (null: empty) and the asked-for columns, whatever else the input has.

    Rows may repeat an id: ``_tag``, a hash of the text, tells rows of one id apart, and rows that agree
    in both are copies which get the same answer.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("_text"), *columns
    )


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names of columns of our own that the input has none of, whatever its columns are called."""
    taken, prefix = {c.lower() for c in df.columns}, "_own_"
    while any(f"{prefix}{w}".lower() in taken for w in wanted):
        prefix = "_" + prefix
    return [f"{prefix}{w}" for w in wanted]


def doc_id(of: str = "_id") -> Column:
    return F.when(F.col(of) != NULL_ID, F.col(of)).alias("doc_id")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder, on a local master only: on a cluster other executors couldn't read it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="starweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def _released_shuffles(spark: SparkSession):
    """Queries run inside drop their shuffle files when they end; nothing reads these again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    try:
        before = spark.conf.get(name)
    except Exception:  # a Spark without this setting: the garbage collector gets to them later
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Tables written inside of ``scratch``, innermost last.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``keep`` writes inside are deleted at the end; what is to stay is read into a table of its own before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def keep(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later steps survive lost executors.

    The finished steps' shuffle files are released, so the disk holds one step's at a time. ``stays``: beyond ``scratch`` too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/starweave/{label}-{uuid.uuid4().hex}"
    with _released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    if _scratch and not stays:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._starweave_path = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote, once nothing reads it any more."""
    if path := getattr(df, "_starweave_path", None):
        _delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
