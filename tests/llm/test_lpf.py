import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from starweave.llm import lpf


def brute(rows, span=50):
    rows = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in rows:
        for i in range(len(t) - span + 1):
            s = hash(t[i : i + span])
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if first[hash(t[i : i + span])] < d:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((None if d == 2**63 - 1 else d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((None if r._id == 2**63 - 1 else r._id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_query(spark, sf, documents):
    rows = lpf.op10_longest_previous_factors(spark, sf).collect()
    assert sorted(map(tuple, rows), key=str) == brute(documents)


def test_edges(tricky, empty):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    assert got(lpf.remove_repeats(tricky)) == brute(rows)
    assert lpf.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("group", [12_000_000, 2_000, 1])
def test_passages_across_documents(spark, monkeypatch, group):
    """Shared passages at shifting places, low-entropy texts, and groups that are dealt out anew by longer substrings."""
    monkeypatch.setattr(lpf, "BLOCK_BYTES", min(group, 3_000))
    monkeypatch.setattr(lpf, "GROUP_BYTES", group)
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([49, 50, 51, 80, 300]))) for _ in range(8)] + ["a" * 200, "ab" * 90]
    rows = []
    for d in rng.sample(range(1000), 60):
        rows.append((d, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh ") for _ in range(30))]) for _ in range(rng.randrange(6)))))
    rows += [(rows[0][0], rows[3][1]), (rows[0][0], rows[0][1])]
    rows += [(None, rows[3][1]), (None, passages[4] + "null ids")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(lpf.remove_repeats(docs)) == brute(rows)


def test_kept_text_is_returned(spark):
    docs = spark.createDataFrame([(1, "x" * 60), (2, "q" + "x" * 60 + "end")], "doc_id long, text string")
    assert {r._id: r.kept for r in lpf.remove_repeats(docs, with_text=True).collect()} == {1: b"x" * 60, 2: b"qend"}


@pytest.mark.parametrize("depth", [8, 13, 50])
@pytest.mark.parametrize("least", [1, 8])
def test_factor_lengths(depth, least):
    """Every start's longest previous factor against all starts of smaller documents."""
    rng = random.Random(depth)
    texts = ["".join(rng.choice("ab") if rng.random() < 0.9 else "abcabcabcabcabcabcabc" for _ in range(rng.randrange(60, 150))) for _ in range(12)]
    docs = [rng.randrange(6) for _ in texts]
    data, starts, doc = "".join(texts).encode(), [], []
    at = 0
    for d, t in zip(docs, texts, strict=True):
        starts += range(at, at + len(t) - depth + 1)
        doc += [d] * (len(t) - depth + 1)
        at += len(t)

    def common(a, b):
        return next((k for k in range(depth) if data[a + k] != data[b + k]), depth)

    want = [max((common(i, j) for j, e in zip(starts, doc, strict=True) if e < d), default=0) for i, d in zip(starts, doc, strict=True)]
    found = lpf.longest_previous(data, np.array(starts), np.array(doc), depth, least)
    assert found.tolist() == [w if w >= least else 0 for w in want]


def test_shared_hashes_are_streamed_whole():
    """Groups over several batches, null ids, rows known to be shared, against a plain grouping."""
    rng = random.Random(6)
    rows = sorted((rng.randrange(9), rng.choice([1, 2, 3, lpf.NULL_ID]), rng.randrange(5), rng.random() < 0.03) for _ in range(60))
    rows = [(h, 1 if h in (2, 7) else d, t, s and h not in (2, 7)) for h, d, t, s in rows]
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 7], strict=True)], ["h", "_id", "_tag", "sure"]) for k in range(0, len(rows), 7)]
    out = sorted(r for b in lpf.several_ids(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    several = {h for h, *_ in rows if len({d for g, d, *_ in rows if g == h}) > 1 or any(s for g, *_, s in rows if g == h)}
    assert out == sorted(r[:3] for r in rows if r[0] in several)
