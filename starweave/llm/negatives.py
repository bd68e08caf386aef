"""Hard negatives by distributed radix selection.

Scores are whole numbers, so the kth largest of a set that lies in many tasks is found digit by digit: every task
counts the scores of its rows by their leading digit, the counts are added, and the digit of the kth is known; the next
round counts the next digit of those that share it. Only then are rows gathered, those at or above the kth. Two
selections run like this:

1. for each anchor, over the rows of its label: its positives;
2. for each anchor and positive score, over the rows of other labels whose score lies in the window: the negatives.

Ties go on with the digits of the vec_id, so a vector that a third of all rows share makes a few more rounds and no larger
group: a selection ends when at most ``GATHERED`` rows are at or above its kth digit, which are then ranked exactly.
A task's counts end at its own kth row, as what lies below can't be among the first k of all.

Rows are dealt into chunks by a hash, anchors into blocks; each part of the chunks meets every block, and their scores are
one matrix product. So nothing grows with the rows in one task, and no score is shuffled that isn't gathered.

* A null vec_id or label, a null vector, and a null or non-finite component keep a row out. Vectors of different lengths
  have no score. Rows that agree in everything are one row; rows that share a vec_id are rows of their own, in the order of a hash.
* An empty table gives no rows; extra columns are ignored. Scaled components must be below 2**26, else ValueError.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave.llm.common import discard, keep, partitions, table
from starweave.llm.vectors import products, whole_components

SCALE, LABELS = 256, 10
ANCHORS, SHIFTED = 100, 7
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this share of the positive's, in hundredths.
LEAST_SHARE = 80
#: Bits of a digit, and how many rows a finished selection may gather for its k.
DIGIT, GATHERED = 10, 4
#: Rows of a chunk and anchors of a block: with 64 components a chunk is 1 MB and the scores of a block's anchors 8 MB.
CHUNK, BLOCK = 4096, 256
#: Pairs of a chunk and a block that a worker gets at a time.
PAIRS_AT_ONCE = 2
LOW = 2**32 - 1

#: What rows are ordered by, after each other, each rising with the order's opposite: score, the id's two halves, the hash.
FIELDS = ("score", "high", "low", "hash")
ANCHOR = ("anchor_id", "anchor_hash")
STATE = ("phase", "e0", "e1", "e2", "lo", "hi", "need", "done")


def takers(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``v``, ``hash``: the different rows that take part."""
    known = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").withColumn("label", F.col("label").cast("long"))
    whole = whole_components(known, SCALE, ("label",))
    moved = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return whole.withColumn("label", moved).dropDuplicates().withColumn("hash", F.xxhash64("label", "v").bitwiseAND(F.lit(2**62 - 1)))


def chunks(rows: DataFrame, n: int, parts: int) -> DataFrame:
    """The rows dealt into chunks of one length of vectors, and the chunks into parts; ``meet`` numbers parts and lengths."""
    chunk = F.pmod(F.xxhash64("vec_id", "hash"), F.lit(max(1, math.ceil(n / CHUNK))))
    held = rows.groupBy(chunk.alias("chunk"), F.size("v").alias("size")).agg(F.collect_list(F.struct("vec_id", "label", "hash", "v")).alias("rows"))
    return held.select((F.col("size") * F.lit(parts).cast("long") + F.pmod("chunk", F.lit(parts))).alias("meet"), "size", "rows")


def blocks(anchors: DataFrame, windows: DataFrame, n: int, parts: int) -> DataFrame:
    """Anchors with their windows, dealt into blocks; each block once for each part."""
    of = windows.groupBy(*ANCHOR).agg(F.collect_list(F.struct("window", "top", *STATE[:6])).alias("windows"))
    block = F.pmod(F.xxhash64(*ANCHOR), F.lit(max(1, math.ceil(n / BLOCK))))
    held = anchors.join(of, [*ANCHOR]).groupBy(block.alias("block"), F.size("v").alias("size")).agg(F.collect_list(F.struct(*ANCHOR, "label", "v", "windows")).alias("anchors"))
    first = F.col("size") * F.lit(parts).cast("long")
    return held.select(F.explode(F.sequence(first, first + F.lit(parts - 1))).alias("meet"), "anchors")


class Chunk:
    """A chunk's rows as arrays."""

    def __init__(self, rows: pa.StructArray, size: int):
        of = lambda name: rows.field(name).to_numpy(zero_copy_only=False)
        self.ids, self.label, hashes = of("vec_id"), of("label"), of("hash")
        self.v = matrix(rows.field("v"), len(rows), size)
        self.hash = hashes
        self.fields = (None, ~(self.ids >> 32), ~(self.ids & LOW), ~hashes)


def matrix(v: pa.ListArray, n: int, size: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(n, size)


def each_window(batch: pa.RecordBatch, alike: bool) -> Iterator[tuple]:
    """(chunk, scores, rows that may count, anchor, window) of every window that meets a chunk; ``alike``: same label."""
    for k in range(len(batch)):
        size = batch.column("size")[k].as_py()
        chunk = Chunk(batch.column("rows")[k].values, size)
        held = batch.column("anchors")[k].values
        scores = products(matrix(held.field("v"), len(held), size), chunk.v)
        slim = pa.StructArray.from_arrays([held.field(c) for c in (*ANCHOR, "label", "windows")], [*ANCHOR, "label", "windows"])
        for a, anchor in enumerate(slim.to_pylist()):
            same = chunk.label == anchor["label"]
            if alike:
                same &= (chunk.ids != anchor["anchor_id"]) | (chunk.hash != anchor["anchor_hash"])
            rows = np.flatnonzero(same if alike else ~same)
            s = scores[a, rows]
            for w in anchor["windows"]:
                yield chunk, s, rows, anchor, w


def met(chunk: Chunk, s: np.ndarray, rows: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places among ``rows`` that share the window's digits so far, and the rest of their current field."""
    phase = w["phase"]
    here = np.flatnonzero(s == w["e0"]) if phase else np.arange(len(s))
    for p in range(1, phase):
        here = here[chunk.fields[p][rows[here]] == w[f"e{p}"]]
    value = s[here] if phase == 0 else chunk.fields[phase][rows[here]]
    inside = (value >= w["lo"]) & (value <= w["hi"])
    return here[inside], value[inside] - w["lo"]


def shift_of(lo: int, hi: int, bits: int) -> int:
    return max(0, (hi - lo).bit_length() - bits)


def counted(pairs: DataFrame, alike: bool, k: int, bits: int) -> DataFrame:
    """(anchor, window, digit, n): how many rows of a part have each digit, from the largest digit to that of its kth row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, s, rows, anchor, w in each_window(batch, alike):
                _, u = met(chunk, s, rows, w)
                if not len(u):
                    continue
                digit = u >> shift_of(w["lo"], w["hi"], bits)
                if len(digit) > k:
                    digit = digit[digit >= np.partition(digit, -k)[-k]]
                out += [(anchor["anchor_id"], anchor["anchor_hash"], w["window"], int(d), int(n)) for d, n in zip(*np.unique(digit, return_counts=True), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5)], [*ANCHOR, "window", "digit", "n"])

    return pairs.mapInArrow(run, "anchor_id long, anchor_hash long, window long, digit long, n long").groupBy(*ANCHOR, "window", "digit").agg(F.sum("n").alias("n"))


def gathered(pairs: DataFrame, alike: bool) -> DataFrame:
    """The rows at or above each finished window's kth digit: (anchor, window, vec_id, hash, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, s, rows, anchor, w in each_window(batch, alike):
                # in the order of the fields: above at one of them and equal at all before
                here, found = np.flatnonzero(s <= w["top"]), []
                for p in range(w["phase"] + 1):
                    value = s[here] if p == 0 else chunk.fields[p][rows[here]]
                    if p == w["phase"]:
                        found.append(here[value >= w["lo"]])
                    else:
                        found.append(here[value > w[f"e{p}"]])
                        here = here[value == w[f"e{p}"]]
                for x in np.concatenate(found):
                    r = rows[x]
                    out.append((anchor["anchor_id"], anchor["anchor_hash"], w["window"], int(chunk.ids[r]), int(chunk.hash[r]), int(s[x])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6)], [*ANCHOR, "window", "vec_id", "hash", "score"])

    return pairs.mapInArrow(run, "anchor_id long, anchor_hash long, window long, vec_id long, hash long, score long")


@contextlib.contextmanager
def few_at_once(spark: SparkSession):
    """Workers get a few pairs of a chunk and a block at a time, as each is some MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PAIRS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Selection:
    """The first k rows of every window, over chunks that all windows' anchors meet."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, n: int, bounds: dict, bits: int):
        self.spark, self.anchors, self.bounds, self.bits = rows.sparkSession, anchors, bounds, bits
        self.parts = max(1, min(partitions(self.spark), math.ceil(n / CHUNK)))
        self.chunks = keep(chunks(rows, n, self.parts), "chunks")

    def pairs(self, windows: DataFrame) -> DataFrame:
        dealt = blocks(self.anchors, windows, windows.select(*ANCHOR).distinct().count(), self.parts)
        return self.chunks.repartition(self.parts, "meet").hint("merge").join(dealt.repartition(self.parts, "meet"), "meet").select("size", "rows", "anchors")

    def first(self, windows: DataFrame, k: int, alike: bool) -> DataFrame:
        """(anchor, window, vec_id, hash, score, rank) of the first k rows of each of ``windows`` (anchor, window, lo, top)."""
        start = windows.select(*ANCHOR, "window", "top", F.lit(0).alias("phase"), *[F.lit(0).cast("long").alias(f"e{p}") for p in range(3)], "lo", F.col("top").alias("hi"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("done"))
        state = keep(start, "windows")
        every = state.where("done")
        while state.limit(1).count():
            with few_at_once(self.spark):
                counts = keep(counted(self.pairs(state), alike, k, self.bits), "digits")
            after = keep(self.refined(state, counts, k), "windows")
            discard(counts)
            every, state = every.union(after.where("done")), after.where("not done")
        with few_at_once(self.spark):
            found = keep(gathered(self.pairs(every), alike), "gathered")
        order = Window.partitionBy(*ANCHOR, "window").orderBy(F.desc("score"), "vec_id", "hash")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def refined(self, state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
        """The windows with the digit of their kth row; windows that no row met are gone."""
        falls = Window.partitionBy(*ANCHOR, "window").orderBy(F.desc("digit"))
        upto = counts.withColumn("upto", F.sum("n").over(falls.rowsBetween(Window.unboundedPreceding, 0)))
        with_need = upto.join(state, [*ANCHOR, "window"])
        # the first digit with the kth row, or the last of all where there are fewer rows
        reached = F.min(F.when(F.col("upto") >= F.col("need"), F.struct("upto", "digit", "n")))
        picked = with_need.groupBy(*ANCHOR, "window", "top", *STATE).agg(F.coalesce(reached, F.max(F.struct("upto", "digit", "n"))).alias("at"))
        width = digit_width(F.col("hi") - F.col("lo"), self.bits)
        lo = F.col("lo") + F.col("at.digit") * width
        above = F.col("at.upto") - F.col("at.n")
        narrowed = picked.select(
            *ANCHOR, "window", "top", "phase", "e0", "e1", "e2", lo.alias("lo"), F.least("hi", lo + width - 1).alias("hi"), (F.col("need") - above).alias("need"),
            (F.lit(k) - F.col("need") + F.col("at.upto") <= GATHERED * k).alias("few"),
        )
        single = (F.col("lo") == F.col("hi")) & ~F.col("few")
        last = F.col("phase") == len(FIELDS) - 1
        follows = lambda which: F.element_at(F.array(*[F.lit(x).cast("long") for x in [self.bounds[f][which] for f in FIELDS[1:]]]), F.least(F.col("phase") + 1, F.lit(len(FIELDS) - 1)))
        opens = single & ~last
        moved = {f"e{p}": F.when(opens & (F.col("phase") == p), F.col("lo")).otherwise(F.col(f"e{p}")) for p in range(3)}
        return narrowed.select(
            *ANCHOR, "window", "top", F.when(opens, F.col("phase") + 1).otherwise(F.col("phase")).alias("phase"), *[c.alias(n) for n, c in moved.items()],
            F.when(opens, follows(0)).otherwise(F.col("lo")).alias("lo"), F.when(opens, follows(1)).otherwise(F.col("hi")).alias("hi"), "need", (F.col("few") | single & last).alias("done"),
        )


def digit_width(span: Column, bits: int) -> Column:
    """Two to the power of ``shift_of``: how many values one digit stands for."""
    length = F.when(span == 0, 0).otherwise(F.length(F.bin(span)))
    return F.pow(F.lit(2.0), F.greatest(length - bits, F.lit(0))).cast("long")


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchors_by: int = ANCHORS, bits: int = DIGIT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, embedding)."""
    every = keep(takers(rows), "takers")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    seen = every.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("a"), F.max("vec_id").alias("b"), F.max(square).alias("most")).first()
    a, b = seen.a or 0, seen.b or 0
    bounds = {"high": (~(b >> 32), ~(a >> 32)), "low": (~(b & LOW), ~(a & LOW)) if a >> 32 == b >> 32 else (~LOW, -1), "hash": (~(2**62 - 1), -1)}
    longest = math.isqrt(seen.most or 0) + 1
    anchors = keep(every.where(F.col("vec_id") % anchors_by == 0).select(F.col("vec_id").alias("anchor_id"), F.col("hash").alias("anchor_hash"), "label", "v", square.alias("square")), "anchors")
    select = Selection(every, anchors, seen.n, bounds, bits)
    reach = F.ceil(F.sqrt("square") + 1).cast("long") * longest  # no score of the anchor is larger
    own = anchors.select(*ANCHOR, F.lit(0).cast("long").alias("window"), (-reach).alias("lo"), reach.alias("top"))
    chosen = keep(select.first(own, positives, True).select(*ANCHOR, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"({LEAST_SHARE} * window + 99) div 100")
    open_ = chosen.where("positive_score >= 0").select(*ANCHOR, F.col("positive_score").alias("window")).distinct()
    ranked = select.first(open_.select(*ANCHOR, "window", least.alias("lo"), F.col("window").alias("top")), negatives, False)
    found = ranked.select(*ANCHOR, F.col("window").alias("positive_score"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(found, [*ANCHOR, "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
