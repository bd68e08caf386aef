import math
import random

import numpy as np
from pyspark.sql import functions as F

from starweave.llm import quality


def test_held_out_labels(spark, sf):
    """Fitted without every fourth labelled document, judged on these."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rest = labels.where("doc_id % 4 != 0")
    got = {r._id: r for r in quality.classify(docs, rest).collect()}
    held = labels.where("doc_id % 4 = 0").collect()
    assert np.mean([(got[r.doc_id].p_quality >= 0.5) == bool(r.quality) for r in held]) >= 0.95
    insults = ("idiot", "moron", "scum", "clown", "trash", "pathetic", "worthless", "loser", "disgusting", "stupid")
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    toxic = [r for r in held if r.toxic and sum(w.strip(".,") in insults for w in texts[r.doc_id]) >= 2]
    assert toxic
    assert np.mean([got[r.doc_id].p_toxic >= 0.5 for r in toxic]) >= 0.9
    clean = [r for r in held if not r.toxic and r.quality]
    assert np.mean([got[r.doc_id].keep for r in clean]) >= 0.97


def test_query_covers_every_document(spark, sf, documents):
    rows = quality.op8_quality_classifier(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in documents)
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 and r.keep == (r.p_quality >= 0.5 and r.p_toxic < 0.5) for r in rows)


def test_edges(spark, tricky, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 1), (None, 1, 1), (77, None, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(tricky, labels).count() == tricky.count()
    assert quality.classify(tricky, labels.where("false")).count() == tricky.count()
    assert quality.classify(empty, labels).count() == 0


def test_sparse_groups_shrink_toward_their_host(spark):
    rows = [(k, k, "big", "p", 3.0, -3.0) for k in range(400)] + [(1000 + k, k, "bad", "p", -3.0, -3.0) for k in range(400)] + [(2000, 0, "bad", "q", 0.0, -3.0), (2001, 0, "big", "q", 0.0, -3.0), (2002, 0, "new", "q", 0.0, -3.0)]
    scored = spark.createDataFrame(rows, "_id long, _tag long, host string, path string, z_quality double, z_toxic double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    p = {r._id: r.p_quality for r in quality.posteriors(scored, none).where("_id >= 2000").collect()}
    assert p[2000] < p[2002] < p[2001]


def twin(rows, labels):
    """Rates, prior strengths and posteriors of rows (id, host, path, z_quality, z_toxic), document by document."""
    known = {}
    for d, *y in labels:
        if d is not None:
            known[d] = [max((x for x in (a, b) if x is not None), default=None) for a, b in zip(known.get(d, [None, None]), y, strict=True)]
    out = [[] for _ in rows]
    for t in (0, 1):
        own = [known.get(r[0], (None, None))[t] if known.get(r[0], (None, None))[t] is not None else 1 / (1 + math.exp(-r[3 + t])) for r in rows]
        groups = {}
        for r, y in zip(rows, own, strict=True):
            for key in ((r[1],), (r[1], r[2])):
                n, s = groups.get(key, (0, 0.0))
                groups[key] = (n + 1, s + y)
        mu = (sum(own) + 1) / (len(own) + 2)

        def strength(width, groups=groups):
            found = [(n, s / n) for key, (n, s) in groups.items() if len(key) == width]
            total = sum(n for n, _ in found)
            if len(found) < 2:
                return 10.0
            mean = sum(n * r for n, r in found) / total
            within = mean * (1 - mean)
            between = (sum(n * (r - mean) ** 2 for n, r in found) - (len(found) - 1) * within) / max(1e-9, total - sum(n * n for n, _ in found) / total)
            return min(1e4, max(2.0, within / between - 1)) if between > 1e-9 else 1e4

        a, b = strength(1), strength(2)
        for k, (r, y) in enumerate(zip(rows, own, strict=True)):
            (m, h), (n, s) = groups[(r[1],)], groups[(r[1], r[2])]
            host = (h - y + a * mu) / (m - 1 + a)
            path = min(1 - 1e-9, max(1e-9, (s - y + b * host) / (n - 1 + b)))
            out[k].append(1 / (1 + math.exp(-(r[3 + t] + math.log(path / (1 - path)) - math.log(mu / (1 - mu))))))
    return out


def test_posteriors_document_by_document(spark, sf):
    """On random evidence with ties and repeats, and on the evidence of the tables' documents."""
    rng = random.Random(2)
    rows = [(k % 250, f"h{min(rng.randrange(9), rng.randrange(9))}", f"p{rng.randrange(3)}", rng.gauss(0, 2), rng.gauss(-2, 1)) for k in range(300)]
    labels = [(rng.randrange(250), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    scored = spark.createDataFrame([(r[0], k, *r[1:]) for k, r in enumerate(rows)], "_id long, _tag long, host string, path string, z_quality double, z_toxic double")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((r._tag, r.p_quality, r.p_toxic) for r in quality.posteriors(scored, frame).collect())
    assert np.allclose([g[1:] for g in got], twin(rows, labels))

    docs, truth = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, truth)
    scored = quality.document_evidence(docs, model).orderBy("_id").collect()
    for r in scored[::50]:
        text = docs.where(F.col("doc_id") == r._id).first().text or ""
        for t, z in zip(quality.TARGETS, (r.z_quality, r.z_toxic), strict=True):
            mean, scale, w = model[t]
            assert np.isclose(z, np.clip(w[0] + sum(a * b for a, b in zip((np.array(quality.evidence(text, model["lexicon"])) - mean) / scale, w[1:], strict=True)), -15, 15))
    want = twin([(r._id, r.host, r.path, r.z_quality, r.z_toxic) for r in scored], [tuple(r) for r in truth.select("doc_id", "quality", "toxic").collect()])
    rows = {r.doc_id: r for r in quality.op8_quality_classifier(spark, sf).collect()}
    assert np.allclose([(rows[r._id].p_quality, rows[r._id].p_toxic) for r in scored], want, atol=1e-6)


def test_ties_and_own_evidence(spark):
    """Equal documents of one path have equal posteriors, and a path of one document tells nothing about it."""
    rows = [(k, 0, "h", "p", 1.0, 0.0) for k in range(5)] + [(9, 0, "alone", "q", 3.0, 0.0), (10, 0, "alone2", "q", -3.0, 0.0)]
    scored = spark.createDataFrame(rows, "_id long, _tag long, host string, path string, z_quality double, z_toxic double")
    p = {r._id: r.p_quality for r in quality.posteriors(scored, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert len({p[k] for k in range(5)}) == 1
    assert math.isclose(p[9], 1 / (1 + math.exp(-3)))
    assert math.isclose(p[10], 1 / (1 + math.exp(3)))


def test_regression_against_plain_gradient_ascent():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4))
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5, 0.0] + 0.3)))).astype(float)
    w = np.zeros(5)
    wide = np.column_stack([np.ones(200), x])
    for _ in range(20_000):
        w += 0.005 * (wide.T @ (y - 1 / (1 + np.exp(-wide @ w))) - np.array([1e-6, 1, 1, 1, 1]) * w)
    assert np.allclose(quality.fit(x, y), w, atol=1e-4)
