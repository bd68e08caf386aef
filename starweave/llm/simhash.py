"""SimHash near-duplicates, searched through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to fixed reference fingerprints (the pivots): the zero
fingerprint and, for each of four 16-bit blocks, twelve masks inside this block. By the triangle inequality a pair
within radius 2 has coordinates that differ by 2 at most, and by the pigeonhole principle such a pair agrees in at
least two of the four blocks, hence in all coordinates of these blocks (relative to zero). So:

1. candidates share the coordinates of two blocks: six cells for each fingerprint, an equi-join;
2. a pair whose largest coordinate difference exceeds 2 is discarded without looking at the fingerprints;
3. survivors are verified by their exact Hamming distance.

Fingerprints are distinct here, so exact copies never meet in a cell. A cell may still be crowded (a large family of
near copies). Crowded cells do not form pairs: fingerprints are within 2 bits exactly if they share a 1-bit
neighbour (themselves included), so their members are grouped by these 65 neighbours, which links the same
fingerprints with rows in proportion to the members. Components are then the connected components of the links.

* null text is empty; texts without words have the fingerprint zero and are linked like any other.
* repeated rows and ties: each row is returned with its component; a null doc_id is a document after all others,
  and names a component (as null) only if all its documents have null ids.
* very long texts are shingled whole; a worker holds a bounded number of hashes, and one text's, at a time.
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starweave.llm.common import NULL_ID, discard, doc_id, free_names, keep, keyed, table
from starweave.llm.graph import components

BLOCKS, WIDTH = 4, 16
MASKS = 12
RADIUS = 2
#: Cells with more fingerprints than this form no pairs and go by shared neighbours instead.
CROWDED = 48
#: Sizes of sets within this factor meet in one step.
SIZE_STEP = 1.02
#: Pairs for each member that a cell of the similarity search forms in its first round, and by how much they grow in each further one.
FIRST_PAIRS, MORE_PAIRS = 8, 8
#: Shingle hashes that a worker holds at a time.
HASHES_AT_ONCE = 400_000


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot_masks(seed: int = 9) -> list[list[int]]:
    """For each block, masks of half its bits such that no two block values have equal distances to all of them."""
    rng = random.Random(seed)
    while True:
        masks = [sum(1 << b for b in rng.sample(range(WIDTH), WIDTH // 2)) for _ in range(MASKS)]
        values = np.arange(1 << WIDTH, dtype=np.uint32)
        key = np.zeros(1 << WIDTH, dtype=np.uint64)
        for m in masks:
            key = key * np.uint64(WIDTH + 1) + np.bitwise_count(values & np.uint32(m)).astype(np.uint64)
        # with the popcount of the block itself, known from the zero pivot and the full mask
        key = key * np.uint64(WIDTH + 1) + np.bitwise_count(values).astype(np.uint64)
        if len(np.unique(key)) > 0.98 * len(values):
            return [[m << (WIDTH * b) for m in [*masks, (1 << WIDTH) - 1]] for b in range(BLOCKS)]


def fingerprints(docs: DataFrame, words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, ``_tag``, ``fp`` (a signed 64-bit long) for each row: whole texts, repeated shingles counted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            fps, hashes, counts = [], [], []
            for text in batch.column("_bytes").to_pylist():
                w = text.lower().split()  # bytes: A-Z only, and white space \x20 \x09-\x0D only
                if len(w) <= words:
                    own = [digest(b" ".join(w), 42)] if w else []
                else:
                    own = [digest(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(words)), strict=False)]
                hashes += own
                counts.append(len(own))
                if len(hashes) >= HASHES_AT_ONCE:
                    fps.append(vote(hashes, counts))
                    hashes, counts = [], []
            fps.append(vote(hashes, counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(fps).view(np.int64))], [*batch.schema.names[:-1], "fp"])

    rows = keyed(docs, *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    return rows.select("_id", "_tag", *carry, F.col("_text").cast("binary").alias("_bytes")).mapInArrow(run, f"{kinds}, fp long")


def vote(hashes: list[int], counts: list[int]) -> np.ndarray:
    """Fingerprints of documents with ``counts`` hashes each: a bit is set if over half of the hashes have it."""
    out = np.zeros(len(counts), dtype=np.uint64)
    n = np.array(counts, dtype=np.int64)
    if not n.sum():
        return out
    lanes = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    has = np.flatnonzero(n)
    # sums of up to 255 rows fit into the bytes of eight longs; these partial sums are then added as numbers
    per = (n[has] + 254) // 255
    first = np.cumsum(n[has]) - n[has]
    doc = np.repeat(np.arange(len(has)), per)
    begin = first[doc] + 255 * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    part = np.add.reduceat(lanes, begin, axis=0).view(np.uint8).astype(np.int64)
    total = np.add.reduceat(part, np.cumsum(per) - per, axis=0)
    bits = (2 * total > n[has][:, None]).astype(np.uint8)
    out[has] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def pivot_table(distinct: DataFrame) -> DataFrame:
    """``fp``, ``dist`` (distances to all pivots) and ``cells`` (one long for each pair of blocks)."""
    masks = pivot_masks()
    to = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p))))
    zero = to(0)
    base = 2 * WIDTH + 1

    def cell(blocks: tuple[int, int]) -> Column:
        # coordinates relative to the zero pivot depend on the block's bits alone
        return F.xxhash64(F.lit(BLOCKS * blocks[0] + blocks[1]), *[(to(p) - zero + base) for b in blocks for p in masks[b]])

    return distinct.select(
        "fp",
        F.array(zero.cast("tinyint"), *[to(p).cast("tinyint") for block in masks for p in block]).alias("dist"),
        F.array(*[cell(b) for b in combinations(range(BLOCKS), 2)]).alias("cells"),
    )


def links(distinct: DataFrame) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of distinct ``fp`` within ``RADIUS`` bits."""
    pivots = keep(pivot_table(distinct), "pivots")
    slim = pivots.select("fp", F.explode("cells").alias("cell"))
    crowd = slim.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = keep(crowd, "cells")
    few = cells.where(F.col("n") <= CROWDED).select("cell")
    member = keep(pivots.select("fp", "dist", F.explode("cells").alias("cell")).join(few, "cell"), "members")
    a, b = member.alias("a"), member.alias("b")
    apart = F.array_max(F.zip_with("a.dist", "b.dist", lambda x, y: F.abs(x - y)))
    pairs = (
        a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")))
        .where(apart <= RADIUS)
        .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    crowded = cells.where(F.col("n") > CROWDED).select("cell")
    inside = slim.join(crowded, "cell").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    # at most 65 fingerprints share a neighbour, so these groups are bounded
    near = inside.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = near.select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).where("src < dst")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """Each row's ``_id``, ``_tag``, ``fp`` and ``component``: the smallest ``_id`` reachable over links."""
    found = keep(fingerprints(docs, words), "fingerprints")
    distinct = keep(found.groupBy("fp").agg(F.min("_id").alias("least")), "distinct")
    roots = components(links(distinct), distinct.sparkSession)  # fp -> root, of linked fingerprints only
    rooted = keep(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "root"), "rooted")
    linked = rooted.where("root is not null")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    named = linked.join(best, "root").select("fp", F.col("best").alias("component"))
    # a fingerprint without links is its own component, and takes no part in the join
    named = named.unionByName(rooted.where("root is null").select("fp", F.col("least").alias("component")))
    named = keep(named, "named")
    return found.join(named, "fp")


# --- near duplicates by shingle similarity, for corpora in which "near" reaches further than two bits


def least_shared(n: Column, similarity: float) -> Column:
    """How many of its ``n`` shingles a set shares with any set that is similar enough."""
    return F.ceil(n * F.lit(similarity) - 1e-6).cast("int")


def shingle_sets(rows: DataFrame, words: int, similarity: float | None = None) -> DataFrame:
    """``_id``, ``_tag``, ``node`` (a hash of the shingle set), ``n`` (its size) and ``s``, sorted hashes of the shingles.

    With a similarity, ``s`` is only the set's smallest part: n - least + n // 10 hashes (with 1 at least for the last term),
    where ``least`` is what the set shares with a similar one. Two similar sets share ``n // 10`` hashes of these parts,
    n being the smaller size: at most n - least hashes of either are missing in the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        odd, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

        def shingles(text: bytes) -> np.ndarray:
            w = text.lower().split()  # bytes: A-Z only, and white space \x20 \x09-\x0D only
            if not w:
                return np.zeros(0, dtype=np.uint64)
            h = np.fromiter(map(digest, w), dtype=np.uint64, count=len(w))
            wide = min(words, len(w))
            m = len(w) - wide + 1
            out = np.full(m, wide, dtype=np.uint64)
            for j in range(wide):
                out = (out ^ h[j : j + m]) * odd
                out ^= out >> np.uint64(32)
                out *= mix
                out ^= out >> np.uint64(29)
            return np.unique(out)

        def flush(batch: pa.RecordBatch, begin: int, nodes: list[int], sizes: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            at = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            s = pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))
            own = [c.slice(begin, len(nodes)) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*own, pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), s], ["_id", "_tag", "node", "n", "s"])

        for batch in batches:
            begin, held = 0, 0
            nodes, sizes, parts = [], [], []
            for k, text in enumerate(batch.column("_bytes")):
                s = shingles(text.as_py())
                n = len(s)
                nodes.append(digest(s.tobytes(), 42))
                sizes.append(n)
                if similarity is not None:
                    s = s[: n - math.ceil(n * similarity - 1e-6) + max(1, n // 10)]
                parts.append(s)
                held += len(s)
                if held >= HASHES_AT_ONCE:
                    yield flush(batch, begin, nodes, sizes, parts)
                    begin, held = k + 1, 0
                    nodes, sizes, parts = [], [], []
            if nodes:
                yield flush(batch, begin, nodes, sizes, parts)

    bytes_ = rows.select("_id", "_tag", F.col("_text").cast("binary").alias("_bytes"))
    return bytes_.mapInArrow(run, "_id long, _tag long, node long, n int, s array<long>")


def possible_nodes(found: DataFrame, similarity: float) -> DataFrame:
    """``node`` of the sets whose smallest parts share as many hashes with other sets as those of similar sets must."""
    part = found.select("node", "n", F.explode("s").alias("h"))
    shared = keep(part.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select(F.col("h").alias("shared")), "shared")
    # rows of one node are copies: its hits are counted for all of them and divided
    hits = part.join(shared, F.col("h") == F.col("shared"), "left_semi").groupBy("node", "n").agg(F.count(F.lit(1)).alias("hits"))
    rows = found.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    need = F.greatest(F.lit(1), F.floor(least_shared(F.col("n"), similarity) / 10))
    return hits.join(rows, "node").where(F.col("hits") >= need * F.col("rows")).select("node")


def prefix_cells(sets: DataFrame, similarity: float) -> DataFrame:
    """``cell``, ``node``, ``n``, ``before``: each set under its n - least + 1 rarest shingles; similar sets share one of them.

    Shingles of one set alone are the rarest; they take their places but open no cell. ``before`` is the number of the set's
    shingles that come before the cell's, in the order that all sets have.
    """
    each = sets.select("node", "n", F.explode("s").alias("h"))
    often = keep(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.col("h").alias("shared"), "df"), "often")
    ranked = each.join(often, F.col("h") == F.col("shared")).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("c"))
    take = F.size("c") - least_shared(F.col("n"), similarity) + 1
    # take counts from the last place that a shingle may have, so what no other set has is left out of it
    rare = ranked.where(take > 0).select("node", "n", (F.col("n") - F.size("c")).alias("own"), F.posexplode(F.slice("c", F.lit(1), F.greatest(take, F.lit(1)))).alias("k", "c"))
    return rare.select(F.col("c.h").alias("cell"), "node", "n", (F.col("own") + F.col("k")).alias("before"))


def with_reach(cells: DataFrame, similarity: float) -> DataFrame:
    """``cells`` with ``reach``: the size of the largest set that a member can be similar to, if the cell is the first they share.

    In the first cell that two similar sets share, all that they share comes from here on. So a pair can only be similar there
    if each one's size is within the other's reach; in later cells it needn't be. The smaller one of such a pair reaches its own size.
    """
    rest = (F.col("n") - F.col("before") + F.lit(1e-6)) * F.lit((1 + similarity) / similarity)
    return cells.select("cell", "node", "n", (F.floor(rest) - F.col("n")).cast("int").alias("reach"))


def may_share(a: str, b: str) -> Column:
    return (F.col(f"{a}.n") <= F.col(f"{b}.reach")) & (F.col(f"{b}.n") <= F.col(f"{a}.reach"))


def size_step(n: Column) -> Column:
    """Sizes in steps of 2 per cent: what lies within a member's reach is in a dozen of them."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(SIZE_STEP))).cast("int")


def possible_members(cells: DataFrame) -> DataFrame:
    """Members (cell, node, n, reach) that may have a partner in their cell, with ``pairs``: how many pairs the cell has at most.

    Counted by classes of equal (n, reach). A cell in which no class reaches another one's size, as that of a text that many
    documents share between words of their own, is left out here, however many members it has.
    """
    classes = keep(cells.groupBy("cell", "n", "reach").agg(F.count(F.lit(1)).alias("k")), "classes")
    able = F.col("reach") >= F.col("n")
    none = F.lit(0).cast("long")
    # how many members are of a size up to some place: from just before a class's own size to its reach
    marks = classes.select("cell", F.col("n").alias("at"), F.col("k").alias("add"), none.alias("k"), none.alias("sign"), none.alias("n"), none.alias("reach"))
    for at, sign in ((F.col("n") - 1, -1), (F.col("reach"), 1)):
        marks = marks.union(classes.where(able).select("cell", at.alias("at"), none, "k", F.lit(sign).cast("long"), "n", "reach"))
    upto = F.sum("add").over(Window.partitionBy("cell").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    counted = marks.withColumn("upto", upto).where("sign != 0").groupBy("cell", "n", "reach").agg(F.max("k").alias("k"), F.sum(F.col("sign") * F.col("upto")).alias("met"))
    open_ = counted.where("met > 1").groupBy("cell").agg(F.sum(F.col("k") * (F.col("met") - 1)).alias("pairs"), F.min("n").alias("least"), F.max("reach").alias("most"))
    open_ = keep(open_.withColumnRenamed("cell", "open"), "open")
    found = cells.join(open_, F.col("cell") == F.col("open")).where((F.col("reach") >= F.col("least")) & (F.col("n") <= F.col("most")))
    return found.select("cell", "node", "n", "reach", "pairs")


def pairs_within(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (src, dst) of two sides' members of one cell that are of different labels and may share enough; ``a`` has the smaller sets.

    Sides meet by steps of size within reach, so no more pairs are looked at than may share enough, but for a step's width.
    """
    steps = F.sequence(size_step(F.col("n")), size_step(F.col("reach")))
    a = a.where("reach >= n").select("cell", "node", "n", "reach", "label", F.explode(steps).alias("step")).alias("a")
    b = b.select("cell", "node", "n", "reach", "label", size_step(F.col("n")).alias("step")).alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node"))
    met = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.label") != F.col("b.label"))
    return a.join(b, met & ordered & may_share("a", "b")).select(*between("a.node", "b.node"))


def between(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")


def verified_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (src, dst) of nodes whose shingle sets are similar enough."""
    a = sets.select(F.col("node").alias("src"), F.col("s").alias("a"))
    b = sets.select(F.col("node").alias("dst"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    close = both >= F.lit(similarity) * (F.size("a") + F.size("b") - both) - 1e-9
    return pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where(close).select("src", "dst")


def merged_roots(roots: DataFrame | None, linked: DataFrame) -> DataFrame:
    """(node, root) after more links: only the components that they touch are looked at."""
    if roots is None:
        return components(linked, linked.sparkSession)
    ends = linked
    for end in ("src", "dst"):
        ends = ends.join(roots.select(F.col("node").alias("_node"), F.col("root").alias(f"_{end}")), F.col(end) == F.col("_node"), "left").drop("_node")
    between_roots = keep(ends.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")), "contracted")
    over = keep(components(between_roots, linked.sparkSession).select(F.col("node").alias("_node"), F.col("root").alias("_root")), "over")
    moved = roots.join(over, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))
    fresh = over.join(roots.select(F.col("node").alias("_known")), F.col("_node") == F.col("_known"), "left_anti").select(F.col("_node").alias("node"), F.col("_root").alias("root"))
    after = keep(moved.unionByName(fresh), "roots")
    for old in (roots, between_roots, over):
        discard(old)
    return after


def fingerprint_links(docs: DataFrame, best: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) of nodes whose documents have SimHash fingerprints within ``RADIUS`` bits and are similar enough.

    ``best`` names a document (_id, _tag) for each node. Fingerprints and their pivot tables are those of op9; as equal
    fingerprints are no proof, the sets of both ends are compared. Of nodes with one fingerprint the smallest stands for all.
    """
    prints = keep(fingerprints(docs), "fingerprints")
    own = keep(best.join(prints, ["_id", "_tag"]).groupBy("node").agg(F.min("fp").alias("fp")), "prints")
    first = keep(own.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    near = links(first.select("fp"))
    for end in ("src", "dst"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")), end)
    equal = own.join(first, "fp").where("node != first")
    pairs = near.select(*between("_src", "_dst")).union(equal.select(*between("node", "first"))).distinct()
    return keep(verified_links(keep(pairs, "near-prints"), sets, similarity), "linked-prints")


def with_labels(members: DataFrame, roots: DataFrame, linked: DataFrame) -> DataFrame:
    """Members (cell, node, n, reach, pairs) with ``label``, their component, and ``links``, how many they have."""
    ends = linked.select(F.col("src").alias("end")).union(linked.select("dst")).groupBy("end").agg(F.count(F.lit(1)).alias("more"))
    state = keep(roots.join(ends, F.col("node") == F.col("end")).select(F.col("node").alias("end"), "root", "more"), "state")
    both = members.join(state, F.col("node") == F.col("end"), "left")
    return both.select("cell", "node", "n", "reach", "pairs", F.coalesce("root", "node").alias("label"), F.coalesce("more", F.lit(0)).cast("long").alias("links"))


def similar_links(sets: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of similar ``sets`` (``node``, ``n``, ``s``).

    Pairs that share a cell, and may share enough from there on, are verified once, except those whose components are joined already. A
    cell with few such pairs for its members forms all of them. Any other compares one member, that with the most links so far, with all the rest;
    this member's pairs are then settled here and it leaves this cell, no other does. The members of such a cell are also dealt
    out at random into parts, and form the pairs inside these. Then components are taken anew, so a family of copies becomes one
    component in a few rounds, of links in proportion to its members, be they similar to one original or to each other. What is left
    are pairs of different components; the number of these that a cell may form for each member grows each round, until all are
    settled. ``known`` are links that were verified before; what they join isn't looked at again.
    """
    cells = keep(with_reach(prefix_cells(sets, similarity), similarity), "cells")
    member = possible_members(cells)
    every: DataFrame | None = known
    roots = None if known is None else merged_roots(None, known)  # of the nodes that have links so far
    if roots is None:
        member = member.select("cell", "node", "n", "reach", "pairs", F.col("node").alias("label"), F.lit(0).cast("long").alias("links"))
    else:
        member = with_labels(member, roots, known)
    member = keep(member, "members")
    seen: DataFrame | None = None  # pairs that earlier rounds verified
    allowed = FIRST_PAIRS
    while True:
        first = F.struct("links", F.xxhash64("node").alias("r"), "node", "n", "reach", "label")
        by_label = member.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("k"), F.max(first).alias("lead"), F.max("pairs").alias("pairs"))
        by_cell = by_label.groupBy("cell").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max("lead").alias("lead"), F.max(F.struct("k", "label"))["label"].alias("most"), F.max("pairs").alias("pairs"))
        left = F.least(F.col("pairs"), (F.col("k") * F.col("k") - F.col("same")) / 2)
        sizes = keep(by_cell.where("same < k * k").withColumn("many", left > F.col("k") * allowed), "sizes")
        few = member.join(sizes.where("not many").select("cell", "most"), "cell")
        outside = few.where("label != most")
        # of a pair one lies outside the largest component of the cell: the smaller set, or else the larger one alone
        pairs = pairs_within(outside, few).union(pairs_within(few.where("label = most"), outside))
        # as many parts as a power of two, so that members meet the same others in most of their cells
        parts = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("k") / (2 * allowed))))).cast("long")
        part = F.pmod(F.xxhash64("node", F.lit(allowed)), parts).alias("part")
        crowd = keep(member.join(sizes.where("many").select("cell", "k", "lead"), "cell").select("cell", "pairs", part, F.struct("node", "n", "reach", "label").alias("own"), "lead"), "crowd")
        stars = crowd.where((F.col("own.label") != F.col("lead.label")) & may_share("own", "lead")).select(*between("own.node", "lead.node"))
        a, b = (crowd.select("cell", "part", "own.*").alias(x) for x in "ab")
        inside = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.label") != F.col("b.label")) & (F.col("a.node") < F.col("b.node"))
        some = a.join(b, inside & may_share("a", "b")).select(*between("a.node", "b.node"))
        todo = pairs.union(stars).union(some).distinct()
        if seen is not None:
            todo = todo.join(seen, ["src", "dst"], "left_anti")
        todo = keep(todo, "pairs")
        linked = keep(verified_links(todo, sets, similarity), "linked")
        every = linked if every is None else every.union(linked)
        for old in (sizes, member):
            discard(old)
        if not crowd.limit(1).count():
            return every
        seen = todo if seen is None else seen.union(todo)
        roots = merged_roots(roots, linked)
        rest = crowd.where(F.col("own.node") != F.col("lead.node")).select("cell", "pairs", "own.node", "own.n", "own.reach")
        member = keep(with_labels(rest, roots, every), "members")
        discard(crowd)
        allowed *= MORE_PAIRS


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Each row's ``_id``, ``_tag`` and ``group``, a number: documents linked by similarity of their shingle sets.

    Nodes are the distinct shingle sets, so copies are one node. Near copies are linked by their SimHash fingerprints, as in op9,
    and verified. What is similar but further than that apart is found by an exact search, so no pair of similar sets is lost:
    two prefix filters find candidates, of which the smallest hashes of all sets leave the sets that may have a partner,
    then the rarest shingles of these sets are cells.
    """
    rows = keyed(docs)
    found = keep(shingle_sets(rows, words, similarity), "parts")
    likely = keep(possible_nodes(found, similarity), "likely")
    best = found.groupBy("node").agg(F.min(F.struct("_id", "_tag")).alias("best"))
    wanted = keep(best.join(likely, "node").select("node", "best._id", "best._tag"), "wanted")
    texts = rows.join(wanted.hint("merge"), ["_id", "_tag"], "left_semi").dropDuplicates(["_id", "_tag"])
    sets = keep(shingle_sets(texts, words).select("node", "n", "s"), "sets")
    known = fingerprint_links(docs, wanted, sets, similarity)
    roots = components(similar_links(sets, similarity, known), docs.sparkSession).select(F.col("node").alias("linked"), "root")
    slim = found.select("_id", "_tag", "node")
    return slim.join(roots, F.col("node") == F.col("linked"), "left").select("_id", "_tag", F.coalesce("root", "node").alias("group"))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input without its near duplicates: of each group the row with the smallest (doc_id, hash of text) stays.

    Null text is empty, and all texts without words are one group; a null doc_id comes after all others. Rows that agree in both
    are copies of which one stays. Texts of fewer words than a shingle have one shingle, all their words. Very long texts are
    shingled whole. All columns pass through, whatever their names; an empty table gives no rows.
    """
    groups = similar_groups(docs, words, similarity)
    one, other = free_names(docs, "id", "tag")
    stay = keep(groups.groupBy("group").agg(F.min(F.struct("_id", "_tag")).alias("best")).select(F.col("best._id").alias(one), F.col("best._tag").alias(other)), "stay")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == stay[one]) & (F.xxhash64(text) == stay[other])
    return docs.join(stay.hint("merge"), same).dropDuplicates([one, other]).drop(one, other)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), doc_id("component").alias("component_id"))
