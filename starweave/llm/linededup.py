r"""Removal of repeated multi-line chunks (built-in functions only).

Lines are hashed, a rolling hash runs over windows of two line hashes, and a chunk begins where the rolling hash is smaller
than both neighbours: boundaries depend on the lines around them alone, so an inserted line shifts no chunk but its own.
Chunks of two or more lines that occur again, anywhere, are removed after a comparison of their bytes with those of
the first occurrence, which stays (in the order of doc_id, then of place).

Only hashes travel at first; texts are fetched for hashes that repeat. A frequent chunk meets its first occurrence in a
plain equi-join of two tables, which Spark splits where it is skewed. Joins that carry texts are sort-merge joins at
every size: what a corpus needs grows with it, and no size has a plan of its own.

* null text is empty; chunks of white space alone stay. A null doc_id comes after all others.
* rows that agree in id and text are one document: all its copies keep the same chunks.
* very long texts are chunked whole; a text of one line is one chunk, and stays.
* extra columns pass through, whatever their names (those of the added columns can be chosen); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import NULL_ID, bind, free_names, keep, table

LEAST_LINES = 2


def line_chunks(text: Column) -> Column:
    """The chunks of a text in order: array of (lines, text). Joined by newlines they are the text again."""

    def boundaries(lines: Column, r: Column) -> Column:
        inner = F.filter(F.sequence(F.lit(1), F.size(lines) - 3), lambda i: (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1)))
        return F.concat(F.array(F.lit(0)), F.when(F.size(lines) >= 4, inner).otherwise(F.array().cast("array<int>")), F.array(F.size(lines)))

    def rolling(h: Column) -> Column:
        at = F.when(F.size(h) >= 2, F.sequence(F.lit(0), F.size(h) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))

    def pieces(lines: Column, b: Column) -> Column:
        def piece(k: Column) -> Column:
            n = F.get(b, k + 1) - F.get(b, k)
            return F.struct(n.alias("lines"), F.array_join(F.slice(lines, F.get(b, k) + 1, n), "\n").alias("text"))

        return F.transform(F.sequence(F.lit(0), F.size(b) - 2), piece)

    def of(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.xxhash64(x))
        return bind(bind(hashes, rolling), lambda r: bind(boundaries(lines, r), lambda b: pieces(lines, b)))

    return bind(F.split(text, "\n"), of)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("_text"))


def repeats(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """(_id, _tag, pos): chunks that go."""
    rows = _rows(docs)
    chunk = rows.select("_id", "_tag", F.posexplode(line_chunks(F.col("_text"))).alias("pos", "c"))
    chunk = chunk.where((F.col("c.lines") >= least_lines) & F.col("c.text").rlike(r"\S")).select("_id", "_tag", "pos", F.xxhash64("c.text").alias("hash"))
    chunk = keep(chunk, "chunks")
    place = F.struct("_id", "_tag", "pos")
    again = keep(chunk.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("hash", "first"), "again")
    both = keep(chunk.join(again, "hash").select("_id", "_tag", "pos", "hash", (place == F.col("first")).alias("first")), "candidates")
    # the texts of these chunks, one pass over the documents
    wanted = both.groupBy("_id", "_tag").agg(F.collect_set(F.struct("pos", "hash", "first")).alias("wanted"))
    found = rows.dropDuplicates(["_id", "_tag"]).join(wanted.hint("merge"), ["_id", "_tag"]).select(
        "_id", "_tag", bind(line_chunks(F.col("_text")), lambda c: F.transform("wanted", lambda w: F.struct(w["hash"].alias("hash"), w["pos"].alias("pos"), w["first"].alias("first"), F.get(c, w["pos"])["text"].alias("text")))).alias("c")
    )
    texts = keep(found.select("_id", "_tag", F.inline("c")), "texts")
    first = texts.where("first").select("hash", F.col("text").alias("same"))
    return texts.where("not first").join(first, "hash").where(F.col("text").cast("binary") == F.col("same").cast("binary")).select("_id", "_tag", "pos")


def dedup_lines(docs: DataFrame, least_lines: int = LEAST_LINES, names: tuple[str, str, str, str] = ("_gone", "_lines", "_chunks", "_gone_lines")) -> DataFrame:
    """The input with ``text`` cut, and columns ``names``: positions of the removed chunks, and numbers of lines, chunks and removed lines.

    Names that the input has already must be given others.
    """
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has columns {sorted(clash)}: give others as names")
    positions, lines, chunks, lost_lines = names
    one, other, whole = free_names(docs, "id", "tag", "rest")
    gone = keep(repeats(docs, least_lines), "gone").groupBy(F.col("_id").alias(one), F.col("_tag").alias(other)).agg(F.collect_set("pos").alias(positions))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == gone[one]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone[other])
    left = docs.join(gone.hint("merge"), same, "left").drop(one, other)

    def rest(c: Column) -> Column:
        goes = lambda i: F.coalesce(F.array_contains(positions, i), F.lit(False))
        kept, lost = F.filter(c, lambda x, i: ~goes(i)), F.filter(c, lambda x, i: goes(i))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["lines"])
        return F.struct(F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"), total(c).alias("lines"), F.size(c).alias("chunks"), total(lost).alias("lost"))

    done = left.withColumn(whole, bind(line_chunks(text), rest))
    cut = F.when(F.col(positions).isNull(), F.col("text")).otherwise(F.col(f"{whole}.text"))
    return done.withColumns({"text": cut, lines: F.col(f"{whole}.lines"), chunks: F.col(f"{whole}.chunks"), lost_lines: F.col(f"{whole}.lost")}).drop(whole)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("_lines").cast("long").alias("n_lines"),
        F.col("_chunks").cast("long").alias("n_chunks"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        F.col("_gone_lines").cast("long").alias("n_removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
