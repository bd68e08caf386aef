import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from starweave.llm import packing


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, capacity, reference):
    ids = reference([t or "" for _, t in docs])
    expected = Counter()
    for (d, _), x in zip(docs, ids, strict=True):
        first = (len(x) - 1) % capacity + 1
        cuts = [0, *range(first, len(x) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[d, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(len(x) for x in ids)


def test_query(spark, sf, documents, reference):
    rows = packing.op3_best_fit_packing(spark, sf).collect()
    used, tokens = check(rows, documents, 1024, reference)
    assert used <= -(-tokens // 1024) * 1.01 + 1


def test_edges(tricky, empty, reference):
    rows = packing.pack_documents(tricky, capacity=64, with_ids=True).collect()
    check(rows, [(r.doc_id, r.text) for r in tricky.collect()], 64, reference)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(empty).count() == 0


def test_ids_are_the_tokenizers(reference):
    rng = random.Random(4)
    letters = " \n\t\r\v.,a1ZéÀ'sltdv_-%  \x00\x1c\x85 中²"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["<|endoftext|> a"]
    got = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_all(texts, 2)
    assert [x.tolist() for x in got] == reference(texts)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    items = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 30, 3000])))
    plan = packing.plan_bins(dict(items), capacity)
    used = Counter()
    for bins, times in plan:
        assert sum(bins) <= capacity
        assert times > 0
        for n in bins:
            used[n] += times
    assert used == items


@pytest.mark.parametrize(("capacity", "least", "most", "seed"), [(12, 1, 12, k) for k in range(25)] + [(40, 8, 24, k) for k in range(40)])
def test_reduction_keeps_the_optimum(capacity, least, most, seed):
    """The fixed bins belong to some optimal solution: exhaustive search on small instances."""
    rng = random.Random(seed)
    items = sorted((rng.randint(least, most) for _ in range(8)), reverse=True)

    def best(items, bins=()):
        if not items:
            return len(bins)
        tried, found = set(), best(items[1:], (*bins, items[0]))
        for k, b in enumerate(bins):
            if b + items[0] <= capacity and b not in tried:
                tried.add(b)
                found = min(found, best(items[1:], (*bins[:k], b + items[0], *bins[k + 1 :])))
        return found

    left = Counter(items)
    fixed = packing.reduce_dominated(left, capacity)
    assert sum(t for _, t in fixed) + best(sorted(left.elements(), reverse=True)) == best(items)


def test_two_partners_are_fixed():
    """20 with 12 and 8 dominates: no pair of items longer than 8 fits beside it. 20 with 13 doesn't dominate 20 with 11 and 9."""
    assert packing.reduce_dominated(Counter([20, 12, 8, 11, 30]), 40)[:2] == [((30, 8), 1), ((20, 12), 1)]
    assert ((20, 12, 7), 1) in packing.reduce_dominated(Counter([20, 12, 7, 11, 10]), 40)
    many = Counter({400: 5000, 380: 3000, 244: 9000, 500: 100, 524: 70})
    items = Counter(many)
    plan = packing.plan_bins(dict(many), 1024)
    used = Counter()
    for bins, times in plan:
        for n in bins:
            used[n] += times
    assert used == items
    assert len(plan) < 200
