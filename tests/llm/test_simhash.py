import itertools
import re

import pytest
import xxhash

from starweave.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    ids = [(2**63 - 1 if d is None else d, fingerprint(t or "")) for d, t in rows]
    distinct = {f for _, f in ids}
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for d, f in ids:
        least[find(f)] = min(d, least.get(find(f), d))
    null = lambda d: None if d == 2**63 - 1 else d
    return sorted(((null(d), f"{f:016x}", null(least[find(f)])) for d, f in ids), key=str)


def test_query_matches_brute_force(spark, sf, documents):
    got = simhash.op9_simhash_near_dedup(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(documents)


def test_edges(tricky, empty):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    out = simhash.near_duplicates(tricky).select(simhash.doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")), simhash.doc_id("component"))
    assert sorted({tuple(r) for r in out.collect()}, key=str) == sorted(set(brute(rows)), key=str)
    assert out.count() >= len(rows)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [48, 1])
def test_links_lose_no_pair(spark, monkeypatch, crowded):
    """Families within a few bits, through the pivots' cells and through shared neighbours."""
    import random

    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        values |= {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
    distinct = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {(r.src % 2**64, r.dst % 2**64) for r in simhash.links(distinct).collect()}
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in got)

    def classes(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for v in values:
            groups.setdefault(find(v), set()).add(v)
        return {frozenset(g) for g in groups.values()}

    assert classes(got) == classes(p for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= 2)
