import random
import re
from collections import Counter

import pytest

from starweave.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, similarity=0.8):
    """Every window of every document against every item."""
    out = {}
    for item_id, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        own = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        n = sum(own.values())
        for doc_id, body in docs:
            d = words(body)
            shingles = [tuple(d[i : i + k]) for i in range(len(d) - k + 1)]
            if not own.keys() & set(shingles):
                continue
            width = min(n, len(shingles))
            for s in range(len(shingles) - width + 1):
                got = Counter(shingles[s : s + width])
                shared = sum((own & got).values())
                sim = shared / (n + width - shared)
                if sim >= similarity - 1e-12:
                    key = (doc_id, item_id)
                    best, start, count = out.get(key, (0, 0, 0))
                    out[key] = (sim, s, count + 1) if sim > best else (best, start, count + 1)
    return {(*k, round(v[0], 6), *v[1:]) for k, v in out.items()}


def test_query(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(documents, items)
    rows = {tuple(r) for r in decontam.op6_benchmark_decontamination(spark, sf).collect()}
    assert rows == want


def test_near_passages_and_edges(spark, tricky, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.randrange(14, 60)))) for k in range(20)] + [(90, None), (91, "two words"), (92, ""), (None, "an item without any id but with words")]
    docs = []
    for k, (_, text) in enumerate(items[:20]):
        w = text.split()
        w[len(w) // 2] = word()  # a changed word takes five shingles
        docs += [(k, " ".join([word() for _ in range(20)] + w + [word() for _ in range(9)])), (100 + k, " ".join(w[3:-3])), (200 + k, text.upper().replace(" ", ", "))]
    docs += [(300, "here are two words"), (301, "An item, without any id; but with words."), (302, " ".join(word() for _ in range(500)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(tricky.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(frame, bench)
    rows = {(r._id, r.item_id, round(r.similarity, 6), r.start_word, r.windows) for r in got.collect()}
    want = brute(docs, items)
    assert rows == want
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(frame, bench.where("false")).count() == 0


def test_windows_right_at_the_similarity(spark, monkeypatch):
    """Hundreds of passages edited down to 0.80 to 0.90: none is lost, with broadcasts and without."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.choice([30, 60, 61, 200])))) for k in range(40)]
    docs = []
    for k in range(400):
        w = items[k % 40][1].split()
        for _ in range(rng.randrange(1, 1 + max(1, len(w) // 50))):
            w[rng.randrange(len(w))] = word()
        docs.append((k, " ".join([word() for _ in range(rng.randrange(30))] + w + [word() for _ in range(rng.randrange(30))])))
    want = brute(docs, items)
    assert sum(w[2] < 0.87 for w in want) > 50
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
        assert {(r._id, r.item_id, round(r.similarity, 6), r.start_word, r.windows) for r in decontam.contaminated(*frames).collect()} == want


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(5)
    for radius in (3, 20, 24):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), radius):
            b ^= 1 << bit
        sign = lambda x: x - 2**64 if x >= 2**63 else x
        row = spark.createDataFrame([(sign(a), sign(b))], "a long, b long").select(decontam.blocks(decontam.F.col("a"), radius).alias("a"), decontam.blocks(decontam.F.col("b"), radius).alias("b")).first()
        assert set(row.a) & set(row.b)
        assert len(row.a) == radius + 1


@pytest.mark.parametrize("size", [1, 7, 60])
def test_simhash_is_a_majority_of_bits(spark, size):
    rng = random.Random(size)
    hashes = [rng.getrandbits(63) * rng.choice((1, -1)) for _ in range(size)]
    got = spark.createDataFrame([(hashes,)], "h array<long>").select(decontam.simhash(decontam.F.col("h"))).first()[0] % 2**64
    assert got == sum(1 << b for b in range(64) if 2 * sum((h % 2**64) >> b & 1 for h in hashes) > size)
