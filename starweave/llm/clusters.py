"""Exact k-means over whole-number vectors, with Yinyang bounds.

The centroids are put into a few groups once. Every vector keeps an upper bound of the distance to its own centroid and
one lower bound for each group: no other centroid of the group is nearer than that. When centroids move, the
bounds move by as much. Then

1. the global filter leaves a vector alone whose upper bound is below all its lower bounds, first as it is, then with the
   exact distance in its place;
2. the group filter leaves out the groups whose lower bound is above the upper bound;
3. the centroids of the groups that are left are scanned, exactly.

Vectors are whole numbers, so all distances are compared as whole numbers; bounds are floats, widened by more than their
rounding, and only decide what is looked at. The state of a round is a table in the shared folder; nothing but the
centroids and their sums, as many as there are clusters, reaches the driver.

* A null vector, one with another number of components, and one with a null or non-finite component take no part.
* A null vec_id is a vector like others, but no first centroid before all that have an id. Repeated rows count as often as they
  occur; ties for the first centroids go by the vector. Fewer vectors than clusters are a cluster each at first.
* An empty table gives no rows; extra columns are ignored. Components must be below 2**26 when scaled, else ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import discard, keep, table
from starweave.llm.vectors import products, squares, whole_components

SCALE, COMPONENTS, CLUSTERS, ROUNDS, GROUPS = 64, 64, 16, 3, 4
#: Bounds are widened by these, relative and absolute, at each step: far more than the rounding of square roots and sums.
RELATIVE, ABSOLUTE = 1e-12, 1e-9


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the hashes' order: as many rows as clusters."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h")
    rows = vectors.select("v", order).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def grouped(centroids: np.ndarray, groups: int) -> list[np.ndarray]:
    """Groups of near centroids, by a few rounds of k-means over the centroids; each is a sorted array of their numbers."""
    k = len(centroids)
    x, middle = centroids.astype(float), centroids[np.linspace(0, k - 1, min(groups, k)).astype(int)].astype(float)
    for _ in range(5):
        own = ((x[:, None] - middle[None]) ** 2).sum(-1).argmin(1)
        middle = np.array([x[own == g].mean(0) if (own == g).any() else middle[g] for g in range(len(middle))])
    return [np.flatnonzero(own == g) for g in range(len(middle)) if (own == g).any()]


def improved(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray, groups: list[np.ndarray]) -> tuple:
    """Nearest centroids and bounds after the centroids moved by ``moved``: (own, upper, lower, scanned distances)."""
    lower = lower * (1 - RELATIVE) - ABSOLUTE - np.array([moved[g].max() for g in groups])
    upper = upper * (1 + RELATIVE) + ABSOLUTE + moved[own]
    scanned = np.zeros(len(x), dtype=np.int32)
    rows = np.flatnonzero(upper >= lower.min(1))
    to_own = squares(x[rows] - centroids[own[rows]])
    scanned[rows] += 1
    upper[rows] = np.sqrt(to_own)
    left = upper[rows] * (1 + RELATIVE) + ABSOLUTE >= lower[rows].min(1)
    rows, to_own = rows[left], to_own[left]
    near, at = to_own.copy(), own[rows].copy()
    seen = []
    for g, members in enumerate(groups):
        part = np.flatnonzero(upper[rows] * (1 + RELATIVE) + ABSOLUTE >= lower[rows, g])
        there, c = x[rows[part]], centroids[members]
        d = squares(there)[:, None] - 2 * products(there, c) + squares(c)[None]
        scanned[rows[part]] += len(members)
        best = d.argmin(1)  # the first of equals has the smaller number
        value, number = d[np.arange(len(part)), best], members[best]
        better = (value < near[part]) | (value == near[part]) & (number < at[part])
        near[part[better]], at[part[better]] = value[better], number[better]
        seen.append((part, d))
    of = np.empty(len(centroids), dtype=int)
    for g, members in enumerate(groups):
        of[members] = g
    # a centroid that is given up is one of the others of its group from now on
    left_behind = np.flatnonzero(at != own[rows])
    behind = of[own[rows[left_behind]]]
    lower[rows[left_behind], behind] = np.minimum(lower[rows[left_behind], behind], np.sqrt(to_own[left_behind]))
    for g, (part, d) in enumerate(seen):
        others = np.where(groups[g][None] == at[part][:, None], np.inf, d)
        lower[rows[part], g] = np.sqrt(others.min(1))
    own, upper = own.copy(), upper.copy()
    own[rows], upper[rows] = at, np.sqrt(near)
    return own, upper, lower, scanned


def assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, groups: list[np.ndarray], first: bool, last: bool) -> DataFrame:
    """The state after one more assignment; ``last`` leaves vec_id, cluster, distance and scanned instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            if first:
                own, upper, lower = np.zeros(n, dtype=int), np.full(n, np.inf), np.full((n, len(groups)), -np.inf)
            else:
                own, upper = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper"))
                lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            own, upper, lower, scanned = improved(x, own, upper, lower, centroids, moved, groups)
            ids, own = batch.column("vec_id"), pa.array(own.astype(np.int32))
            if last:
                distance = squares(x - centroids[own.to_numpy()])
                yield pa.RecordBatch.from_arrays([ids, own, pa.array(distance), pa.array(scanned)], ["vec_id", "cluster", "distance", "scanned"])
            else:
                at = pa.array(np.arange(n + 1, dtype=np.int32) * len(groups))
                bounds = pa.ListArray.from_arrays(at, pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([ids, v, own, pa.array(upper), bounds, pa.array(scanned)], ["vec_id", "v", "cluster", "upper", "lower", "scanned"])

    kinds = "vec_id long, cluster int, distance long, scanned int" if last else "vec_id long, v array<int>, cluster int, upper double, lower array<double>, scanned int"
    return state.mapInArrow(run, kinds)


def means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster's vectors; an empty one stays. One row for each cluster reaches the driver."""
    sums = [F.sum(F.get("v", F.lit(j))).alias(f"s{j}") for j in range(before.shape[1])]
    after = before.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        after[r.cluster] = [r[f"s{j}"] // r.n for j in range(before.shape[1])]
    return after


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, scanned) of each row of ``vectors`` (vec_id, v; all of one length), and the last centroids."""
    vectors = keep(vectors, "vectors")
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0 AS scanned").where("false"), centroids
    parts, still = grouped(centroids, groups), np.zeros(len(centroids))
    state, moved = vectors, still
    for k in range(rounds):
        after = keep(assigned(state, centroids, moved, parts, k == 0, False), "state")
        discard(state)
        new = means(after, centroids)
        # the distances of old and new places, by whole numbers
        moved = np.array([math.sqrt(int(d)) * (1 + RELATIVE) for d in squares(new - centroids)])
        state, centroids = after, new
    done = keep(assigned(state, centroids, moved, parts, rounds == 0, True), "clusters")
    discard(state)
    return done, centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(whole_components(table(spark, sf_dir, "embeddings"), SCALE, components=COMPONENTS))
    inertia = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    each = [inertia.get(k, 0) for k in range(max(1, len(centroids)))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [""]
    pick = lambda values, kind: F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        "vec_id", "cluster", "distance", pick(each, "long").alias("cluster_inertia"), F.lit(sum(each)).cast("long").alias("inertia"), pick(digests, "string").alias("centroid_sha256")
    )
