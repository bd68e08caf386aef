import random
import re

from pyspark.sql import functions as F

from starweave.llm import licenses


def scan(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_query(spark, sf, documents):
    rows = {r.doc_id: r for r in licenses.op4_license_scan(spark, sf).collect()}
    assert len(rows) == len(documents)
    for d, text in documents:
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_edges(tricky, empty):
    rows = licenses.scan(tricky).collect()
    assert len(rows) == tricky.count()
    texts = [(r.doc_id, r.text) for r in tricky.collect()]
    expected = sorted(str((d, *scan(t)[:2], scan(t)[4])) for d, t in texts)
    assert sorted(str((r.doc_id, r.n_words, len(r.base_places), ",".join(r.base_labels))) for r in rows) == expected
    assert licenses.scan(empty).count() == 0


def test_templates(spark):
    texts = [
        (1, "Permission is hereby granted, free of charge, to any person. THE SOFTWARE IS PROVIDED \"AS IS\"", "mit"),
        (2, "permission is hereby granted " + "x " * 900 + "free of charge", ""),
        (3, "SPDX-License-Identifier: MIT", "spdx"),
        (4, "GNU General Public License, see the Free Software Foundation, or any later version", "gpl,gpl-notice"),
        (5, "public license general", ""),
    ]
    rows = licenses.scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).withColumn("l", F.array_join("labels", ",")).collect()
    assert {r.doc_id: r.l for r in rows} == {t[0]: t[2] for t in texts}


def test_every_place_of_every_phrase(spark):
    """The index against a scan of all positions, on texts dense with licence words, whatever the frequencies are."""
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice([rng.choice(licenses.VOCABULARY), rng.choice(licenses.phrases()), "other"]) for _ in range(rng.randrange(40)))) for k in range(60)]
    found = licenses.hits(spark.createDataFrame(docs, "doc_id long, text string"))
    for frequency in (licenses.document_frequencies(found), {w: -k for k, w in enumerate(licenses.VOCABULARY)}):
        rows = found.select("doc_id", "places", licenses.verified(frequency).alias("v")).collect()
        for r in rows:
            w = docs[r.doc_id][1].split()
            want = sorted((k, i) for k, p in enumerate(licenses.phrases()) for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
            assert sorted((x.phrase, r.places[x.hit]) for x in r.v) == want
