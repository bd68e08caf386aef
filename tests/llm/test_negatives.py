import math
import random

from starweave.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, hash int"


def by_hand(rows):
    kept = set()
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e)))
    kept, out = sorted(kept), []
    for a in kept:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1] == a[1]) for b in kept if b != a and len(a[2]) == len(b[2])]
        scored.sort()
        for ps, p in [(-s, i) for s, i, alike in scored if alike][:5]:
            fit = [(-s, i) for s, i, alike in scored if not alike and 80 * ps <= 100 * -s <= 100 * ps]
            out += [(a[0], p, k, i, ps, s) for k, (s, i) in enumerate(fit[:5], 1)]
    return sorted(out)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, negatives.op13_hard_negatives(spark, str(tmp_path)).collect()))


def vectors(n, seed, size=8, labels=4, coarse=None):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        v = [rng.choice(coarse) if coarse else round(rng.gauss(0.3, 0.5) * 1024) / 1024 for _ in range(size)]
        out.append((k, v, rng.randrange(labels)))
    return out


def test_against_plain_loops(spark, tmp_path):
    rows = vectors(700, 1) + vectors(0, 0)
    assert run(spark, tmp_path, rows) == by_hand(rows) != []


def test_ties_of_a_hot_vector(spark, tmp_path):
    """A third of all rows share one vector, ids reach over both halves of a long, scores are few."""
    rows = vectors(300, 2, size=3, coarse=[0.0, 0.5, 1.0])
    rows += [(k * 100 + (k % 5) * 2**40, [0.5, 0.5, 0.5], k % 2) for k in range(4, 150)]
    rows += [(-100 * k - k % 3, [1.0, 0.0, 0.5], k % 3) for k in range(1, 60)]
    assert run(spark, tmp_path, rows) == by_hand(rows) != []


def test_nulls_repeats_and_lengths(spark, tmp_path):
    rows = vectors(250, 3, labels=3) + vectors(5, 3, labels=3)  # the first five are repeated
    rows += [(None, [1.0] * 8, 1), (100_000, None, 1), (100_100, [1.0] * 8, None), (100_200, [float("nan")] * 8, 1), (100_300, [None] * 8, 1), (100_400, [float("-inf")] * 8, 1)]
    rows += [(200_000 + k, [0.5] * 5, k % 2) for k in range(12)] + [(300_000, [], 1), (300_001, [], 1), (300_002, [], 2), (300_006, [], 1)]
    rows += [(400_000, [-0.5, *[0.0] * 7], 9), (400_001, [0.25, *[0.0] * 7], 9), (400_002, [0.0, *[0.5] * 7], 9)]  # scores below zero, and zero
    assert run(spark, tmp_path, rows) == by_hand(rows) != []


def test_digits_of_several_chunks_and_blocks(spark, tmp_path, monkeypatch):
    """Small chunks, blocks and digits: many rounds and tasks, the same rows."""
    for name, value in (("CHUNK", 40), ("BLOCK", 2), ("GATHERED", 1)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(500, 4, size=4, labels=3, coarse=[0.0, 0.125, 0.5, 1.0])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, negatives.hard_negatives(df, bits=4).collect())) == by_hand(rows) != []


def test_one_row_and_none(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(100, [1.0], 1)]) == []
    assert run(spark, tmp_path, [(1, [1.0], 1), (2, [1.0], 2)]) == []
