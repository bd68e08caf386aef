import hashlib
import math
import random

import pytest

from starweave.llm import clusters
from starweave.llm.vectors import whole_components

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster double"


def by_hand(rows):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by plain loops."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1])) + sorted((x for x in kept if x[0] is None), key=lambda x: x[1])
    centroids = [v for _, v in named[:16]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(3):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for k, vs in members.items():
            centroids[k] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = {}
    for _, d, k in final:
        total[k] = total.get(k, 0) + d
    return sorted(((i, k, d, total[k], sum(total.values()), digest[k]) for i, d, k in final), key=str)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, e, 1, "x", 2.0) for i, e in rows], SCHEMA)
    df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, clusters.op12_centroid_clustering(spark, str(tmp_path)).collect()), key=str)


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def random_rows(n, seed, spread=1.0, centres=20):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(centres)]
    return [(k, [single(x + rng.gauss(0, 0.2)) for x in rng.choice(middle)]) for k in range(n)]


def test_against_plain_loops(spark, tmp_path):
    rows = random_rows(400, 1)
    # ties and repeats: one vector many times, coarse vectors, repeated rows
    rows += [(1000 + k, [0.5] * 64) for k in range(150)] + [(2000 + k, [single((k % 3) / 64)] * 64) for k in range(30)] + rows[:5]
    rows += [(None, [0.25] * 64), (None, None), (3000, None), (3001, [1.0] * 63), (3002, [1.0] * 65), (3003, [float("nan")] * 64), (3004, [float("inf")] + [0.0] * 63), (3005, [None] + [0.0] * 63), (3006, [])]
    assert run(spark, tmp_path, rows) == by_hand(rows)


def test_few_vectors_and_none(spark, tmp_path):
    few = random_rows(5, 2)
    assert run(spark, tmp_path, few) == by_hand(few)
    assert run(spark, tmp_path, [(1, None)]) == []
    assert run(spark, tmp_path, [(1, [0.0] * 64)] * 3) == by_hand([(1, [0.0] * 64)] * 3)


def test_extreme_components(spark, tmp_path):
    rows = [(k, [single((-1) ** k * 900_000.0 * (k % 7 + 1) / 7)] * 64) for k in range(40)]
    assert run(spark, tmp_path, rows) == by_hand(rows)
    with pytest.raises(Exception, match="is 67108864 or more"):
        run(spark, tmp_path, [(1, [1e30] * 64)])


def test_bounds_leave_work_out(spark):
    """Exact distances computed: all in the first pass, far fewer than all in the last."""
    rows = random_rows(2000, 3, centres=16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rounds in (0, 3):
        done, centroids = clusters.clustered(whole_components(df, 64, components=64), rounds=rounds)
        scanned = sum(r.scanned for r in done.select("scanned").collect()) / len(rows)
        assert scanned >= len(centroids) if rounds == 0 else scanned < 0.5 * len(centroids)


def test_groups_are_of_centroids():
    import numpy as np

    c = np.array([[0, 0], [100, 0], [1, 0], [101, 1], [0, 100]])
    groups = clusters.grouped(c, 3)
    assert sorted(x for g in groups for x in g.tolist()) == [0, 1, 2, 3, 4]
    assert clusters.grouped(c[:1], 4)[0].tolist() == [0]


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
