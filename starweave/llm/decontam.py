"""Benchmark decontamination by SimHash windows (built-in functions only).

Documents are searched for passages whose word shingles agree with those of a benchmark item, by weighted Jaccard
similarity (weights are the shingles' numbers of occurrences):

1. a window within the similarity holds a number of the item's shingles that follows from it; windows with fewer are left
   out: an exact bound;
2. every other window of an item's size gets a SimHash fingerprint;
3. fingerprints are cut into ``radius + 1`` blocks. Two within the radius agree in at least one of these, so the index of the
   items' blocks guarantees that every item of this size within the radius is found;
4. candidates are verified by the exact weighted shingle similarity.

At similarity 0.8 fingerprints differ in about 10 of 64 bits (deviation 2.9), so the radius is 24, which loses one window in a
million. Blocks for such a radius are narrow: they guarantee, but of the items of one size they leave out few. What selects is the
bound of step 1, then the size, then the distance itself.

* null text and null items are empty; items without words match nothing; items of fewer than five words have shingles
  of all their words. Words are lower-cased (A-Z) and punctuation is left out.
* repeated rows, and repeated items of one id, are reported once; null ids are kept; of windows that tie the first is named.
* very long texts are read whole; a row holds one document's shingles and one window at a time.
* extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import bind, doc_id, keep, keyed, table
from starweave.llm.licenses import words_of

WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
#: Bytes of the benchmark's rows that are broadcast at most; those of a larger benchmark are joined by an exchange.
BROADCAST_BYTES = 32_000_000


def simhash(hashes: Column) -> Column:
    """A bit is 1 if it is in over half of the hashes."""

    def bit(b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, b: f.bitwiseOR(bit(b)))


def shingle_hashes(words: Column, k: int) -> Column:
    """A hash of each ``k`` consecutive words."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    return bind(words, of)


def blocks(fp: Column, radius: int) -> Column:
    """(block, value) of a fingerprint cut into ``radius + 1`` blocks."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    value = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(k).alias("block"), value(a, b).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of hashes: shared occurrences over all occurrences."""
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def benchmark_items(items: DataFrame, k: int = WORDS) -> DataFrame:
    """item_id, k (words in its shingles), shingles, n and fingerprint; kept as a table."""
    words = items.select("item_id", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    found = None
    for size in range(1, k + 1):
        fits = F.size("w") >= k if size == k else F.size("w") == size
        part = words.where(fits).select("item_id", F.lit(size).alias("k"), shingle_hashes(F.col("w"), size).alias("shingles"))
        found = part if found is None else found.unionByName(part)
    hashed = keep(found.dropDuplicates().withColumn("n", F.size("shingles")).withColumn("item", F.xxhash64("item_id", "k", "shingles")), "items")
    return keep(hashed.withColumn("fp", simhash(F.col("shingles"))), "items")


def windows_of(places: Column, n: Column, total: Column, similarity: float) -> Column:
    """Starts of the windows of ``n`` shingles (or the whole, if shorter) that hold enough of the sorted places."""
    width = F.least(n, total)
    need = F.ceil(F.lit(similarity) * (n + width) / (1 + similarity) - 1e-9).cast("int")

    def at(j: Column) -> Column:
        # the first place in the window is places[j], and places[j + need - 1] is inside
        here, last = F.get(places, j), F.get(places, j + need - 1)
        low = F.greatest(F.coalesce(F.get(places, j - 1) + 1, F.lit(0)), last - width + 1, F.lit(0))
        high = F.least(here, total - width)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    ranks = F.when(F.size(places) >= need, F.sequence(F.lit(0), F.size(places) - need)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(ranks, at))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, k: int = WORDS) -> DataFrame:
    """(_id, _tag, item_id, similarity, start_word, windows): verified pairs of document and item, the best window's data."""
    rows = keyed(docs)
    bench = benchmark_items(items, k)
    sizes = bench.groupBy("k").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("shingles")).orderBy("k").collect()  # at most ``k`` rows
    if not sizes:
        return rows.where("false").select("_id", "_tag", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).cast("long").alias("windows"))
    light = lambda df, n_bytes: F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df
    every_hit: DataFrame | None = None
    for size, n_items, n_shingles in sizes:
        mine = bench.where(F.col("k") == size)
        own = mine.select("item", "n", F.explode(F.array_distinct("shingles")).alias("h"))
        met = rows.select("_id", "_tag", F.posexplode(shingle_hashes(words_of(F.col("_text")), size)).alias("pos", "h")).join(light(own, 24 * n_shingles), "h")
        least = math.floor(1000 * similarity) / 1000  # of n shingles, also where the document is shorter than the item
        met = met.groupBy("_id", "_tag", "item", "n").agg(F.collect_set("pos").alias("p")).where(F.size("p") >= F.ceil(F.col("n") * least - 1e-9))
        places = keep(met.select("_id", "_tag", "n", F.sort_array("p").alias("p")).distinct(), "places").groupBy("_id", "_tag").agg(F.collect_list(F.struct("n", "p")).alias("places"))
        # at every size: no plan of its own for few places
        near = rows.dropDuplicates(["_id", "_tag"]).join(places.hint("merge"), ["_id", "_tag"])
        held = keep(near.select("_id", "_tag", shingle_hashes(words_of(F.col("_text")), size).alias("h"), "places"), "held")
        starts = F.array_distinct(F.flatten(F.transform("places", lambda x: F.transform(windows_of(x["p"], x["n"], F.size("h"), similarity), lambda s: F.struct(x["n"].alias("n"), s.alias("start"))))))
        window = lambda x: F.slice(F.col("h"), x["start"] + 1, F.least(x["n"], F.size("h")))
        windows = held.select("_id", "_tag", F.inline(F.transform(starts, lambda x: F.struct(x["n"].alias("n"), x["start"].alias("start"), simhash(window(x)).alias("fp")))))
        probe = keep(windows, "windows").select("*", F.inline(blocks(F.col("fp"), radius)))
        index = mine.select("item", "n", F.col("fp").alias("item_fp"), F.inline(blocks(F.col("fp"), radius)))
        found = probe.join(light(index, 48 * (radius + 1) * n_items), ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        pairs = keep(found.select("_id", "_tag", "n", "start", "item").distinct(), "candidates")
        both = held.select("_id", "_tag", "h").join(pairs, ["_id", "_tag"]).join(light(mine.select("item", "item_id", "shingles"), 64 * n_items + 8 * n_shingles), "item")
        at = F.struct("n", "start")
        close = both.select("_id", "_tag", "item_id", "start", weighted_similarity(window(at), F.col("shingles")).alias("similarity")).where(F.col("similarity") >= similarity)
        every_hit = close if every_hit is None else every_hit.unionByName(close)
    # items of one id may be of several sizes: a window counts once for each
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return every_hit.groupBy("_id", "_tag", "item_id").agg(best, F.count(F.lit(1)).alias("windows")).select("_id", "_tag", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start_word"), "windows")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(doc_id(), "item_id", F.round("similarity", 6).alias("similarity"), "start_word", "windows")
