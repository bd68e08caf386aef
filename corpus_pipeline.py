"""The corpus pipeline: quality, line and near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table: the columns of
``documents`` with ``text`` and ``n_chars`` up to date, and after the last stage the packed pieces.

In every stage null text is empty and a null doc_id is a document after all others; rows that agree in doc_id and text are copies
and share their fate, except that near_dedup keeps one of each group. Ties go by (doc_id, hash of text). Texts of any length are
read whole. Further columns pass through up to the last stage, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import NULL_ID, free_names, keep, scratch, table
from starweave.llm.decontam import contaminated
from starweave.llm.linededup import dedup_lines
from starweave.llm.packing import pack_documents
from starweave.llm.quality import classify
from starweave.llm.simhash import keep_first


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows named by ``gone`` (_id, _tag)."""
    one, other = free_names(docs, "id", "tag")
    gone = keep(gone.select(F.col("_id").alias(one), F.col("_tag").alias(other)).distinct(), "gone")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == gone[one]) & (F.xxhash64(text) == gone[other])
    return docs.join(gone.hint("merge"), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of likely bad quality and likely toxic ones go."""
    return _without(docs, classify(docs, table(spark, sf_dir, "labels")).where("not keep"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go from the texts, all but the first; a document with nothing left goes."""
    gone, *_ = names = free_names(docs, "gone", "lines", "chunks", "gone_lines")
    done = dedup_lines(docs, names=names)
    changed = F.col(gone).isNotNull()
    empty = changed & ~F.col("text").rlike(r"\S")
    chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(~empty).withColumn("n_chars", chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_first(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as packed sequences: one row for each piece."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL has neither the hashes nor the tokenizer of these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
    return docs
