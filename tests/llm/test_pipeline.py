import random
import re

import pytest
from pyspark.sql import functions as F

from starweave.llm import simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y) - 1e-9


@pytest.mark.parametrize("pairs", [48, 1])
def test_near_dedup_against_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "FIRST_PAIRS", pairs)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(80, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            changed = list(base)
            changed[rng.randrange(len(base))] = word()
            texts.append(" ".join(changed))
    texts += ["", None, texts[0], "one two", "One  two"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    stay = {r.doc_id for r in simhash.keep_first(docs).collect()}
    texts = [t or "" for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    assert all(len(stay & set(g)) >= 1 for g in groups.values())
    assert len(stay) == len(groups)


def test_pipeline_on_the_tables(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = set(documents)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, sf), name)
        assert docs.columns == columns
        now = {(r.doc_id, r.text) for r in docs.collect()}
        assert {d for d, _ in now} <= {d for d, _ in before}
        if name != "line_dedup":
            assert now <= before
        assert len(now) > 0.7 * len(before)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in before}


def test_stages_on_odd_rows(spark, sf, tricky, tmp_path):
    docs = tricky.select("doc_id", "text", "lang", "source", "n_chars", "score")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), name).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} >= {1, 2, 6, 7, 9, 10, None}


def test_whole_pipeline_on_clashing_names(spark, sf, tricky, tmp_path):
    """Columns named like those that the operators add, nulls, repeats and very long texts, through all stages."""
    odd = ["_gone", "_gone_id", "_gone_tag", "_rest", "_lines", "_chunks", "_gone_lines", "_stay_id", "_stay_tag", "_own_id", "_own_tag", "_tag", "_text", "group", "pos", "keep", "h"]
    clean = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = tricky.select("doc_id", "text", "lang", "source", "n_chars").unionByName(clean.select("doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(odd)])
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_after = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), name)
        assert docs_after.columns == docs.columns
        assert docs_after.select(*odd).distinct().collect() == [tuple(range(len(odd)))]
        docs = docs_after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0


def groups_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for r in simhash.similar_groups(docs).collect():
        groups.setdefault(r.group, set()).add(r._id)
    return sorted(groups.values(), key=min)


def edited(rng, base, least):
    """A copy of ``base`` with replaced words, no further from it than ``least``."""
    copy, source = list(base), " ".join(base)
    while True:
        more = list(copy)
        more[rng.randrange(len(base))] = f"w{rng.getrandbits(40)}"
        x, y = shingles(source), shingles(" ".join(more))
        if len(x & y) < least * len(x | y):
            return " ".join(copy)
        copy = more


def test_large_family_around_one_original(spark):
    """Copies that are similar to the original and hardly to each other, in thousands, among other texts."""
    rng = random.Random(21)
    base = [f"word{rng.randrange(5000)}" for _ in range(250)]
    texts = [" ".join(base)] + [edited(rng, base, 0.82) for _ in range(2000)]
    texts += [" ".join(f"word{rng.randrange(5000)}" for _ in range(120)) for _ in range(50)]
    order = rng.sample(range(len(texts)), len(texts))
    found = groups_of(spark, [texts[k] for k in order])
    assert sorted(sorted(order[k] for k in g) for g in found) == [list(range(2001)), *[[k] for k in range(2001, 2051)]]


def test_links_grow_with_the_members_of_a_family(spark):
    """Copies of which nearly all pairs are similar, without their original: one group, and few links for each member."""
    rng = random.Random(24)
    base = [f"word{rng.randrange(5000)}" for _ in range(250)]
    texts = [edited(rng, base, 0.9) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = simhash.keep(simhash.shingle_sets(simhash.keyed(docs), 5).select("node", "n", "s"), "sets")
    assert simhash.similar_links(sets, 0.8).count() <= 40 * len(texts)
    assert len(groups_of(spark, texts)) == 1


def test_no_pair_above_the_similarity_is_lost(spark):
    """Pairs of 0.80 to 0.90, with scattered edits or an appended block, and pairs right below 0.8 that stay apart."""
    rng = random.Random(22)
    pairs = []
    while len(pairs) < 150:
        base = [f"word{rng.randrange(5000)}" for _ in range(rng.randrange(150, 400))]
        more = [f"word{rng.randrange(5000)}" for _ in range(int(len(base) * (1 / rng.uniform(0.77, 0.9) - 1)))]
        pairs.append((" ".join(base), rng.choice([edited(rng, base, rng.uniform(0.8, 0.88)), " ".join(base + more)])))
    near = [similar(a, b) for a, b in pairs]
    assert 100 < sum(near) < 150
    found = groups_of(spark, [t for p in pairs for t in p])
    assert found == sorted((g for k, n in enumerate(near) for g in ([{2 * k, 2 * k + 1}] if n else [{2 * k}, {2 * k + 1}])), key=min)


def test_equal_fingerprints_are_no_proof(spark):
    """A repeated phrase decides the fingerprints of texts that share little else."""
    rng = random.Random(23)
    phrase = " ".join(f"p{k}" for k in range(21))
    texts = [" ".join([phrase] * 100 + [f"own{rng.getrandbits(40)}" for _ in range(300)]) for _ in range(40)]
    texts += [texts[0].upper(), "  ".join(texts[1].split(" "))]
    found = groups_of(spark, texts)
    assert found == [{0, 40}, {1, 41}, *[{k} for k in range(2, 40)]]


def test_template_pages_form_no_pairs(spark, monkeypatch):
    """20,000 documents of one template, each with words of its own: no link is possible, so none is looked for."""
    rounds = []
    plain = simhash.verified_links
    monkeypatch.setattr(simhash, "verified_links", lambda pairs, sets, s: rounds.append(pairs.count()) or plain(pairs, sets, s))
    template = " ".join(f"t{k}" for k in range(21))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(template), *[F.concat(F.lit(x), F.col("id").cast("string")) for x in "abc"]).alias("text"))
    sets = simhash.keep(simhash.shingle_sets(simhash.keyed(docs), 5).select("node", "n", "s"), "sets")
    assert simhash.similar_links(sets, 0.8).count() == 0
    assert rounds == [0]


def test_template_pages_with_near_copies_among_them(spark):
    """The template's cell has a few sets that reach others and many that don't; the few are found."""
    rng = random.Random(25)
    template = [f"t{k}" for k in range(21)]
    texts = [" ".join([*template, *[f"own{rng.getrandbits(40)}" for _ in range(4)]]) for _ in range(300)]
    texts += [" ".join([*template, "tail"]), " ".join([*template, "other"])]
    assert similar(texts[-1], texts[-2])
    assert all(not similar(texts[0], t) for t in texts[-2:])
    assert groups_of(spark, texts) == [*[{k} for k in range(300)], {300, 301}]


def test_possible_members_lose_no_pair(spark):
    """Cells of random sizes and reaches against all pairs."""
    rng = random.Random(26)
    rows = [(rng.randrange(6), k, n := rng.randrange(1, 30), rng.randrange(0, int(1.25 * n) + 1)) for k in range(400)]
    cells = spark.createDataFrame(rows, "cell long, node long, n int, reach int")
    want, bound = set(), {}
    for c, a, n, r in rows:
        for d, b, m, q in rows:
            if c == d and a != b and n <= q and m <= r:
                want.add((min(a, b), max(a, b)))
    kept = simhash.possible_members(cells).collect()
    assert {x for p in want for x in p} <= {r.node for r in kept}
    for c in range(6):
        bound[c] = sum(1 for a, b in want if rows[a][0] == c)
        assert all(r.pairs >= bound[c] for r in kept if r.cell == c)
    member = simhash.possible_members(cells).withColumn("label", F.col("node"))
    assert {(r.src, r.dst) for r in simhash.pairs_within(member, member).collect()} == want


def test_near_copies_are_linked_by_their_fingerprints(spark, monkeypatch):
    """SimHash joins copies within two bits, so that nothing is left to the search; it joins no texts that only share a fingerprint."""
    from test_simhash import fingerprint

    rng = random.Random(27)
    base = [f"word{rng.randrange(5000)}" for _ in range(2000)]
    texts, own = [" ".join(base)], fingerprint(" ".join(base))
    while len(texts) < 12:
        copy = list(base)
        copy[rng.randrange(len(base))] = f"w{rng.getrandbits(40)}"
        if (fingerprint(" ".join(copy)) ^ own).bit_count() <= 2:
            texts.append(" ".join(copy))
    phrase = " ".join(f"p{k}" for k in range(21))
    texts += [" ".join([phrase] * 100 + [f"own{rng.getrandbits(40)}" for _ in range(300)]) for _ in range(3)]
    searched, rounds = [], []
    plain_links, plain = simhash.links, simhash.verified_links
    monkeypatch.setattr(simhash, "links", lambda distinct: searched.append(distinct.count()) or plain_links(distinct))
    monkeypatch.setattr(simhash, "verified_links", lambda pairs, sets, s: rounds.append(pairs.count()) or plain(pairs, sets, s))
    assert groups_of(spark, texts) == [set(range(12)), {12}, {13}, {14}]
    assert len(searched) == 1 and searched[0] > 1
    assert rounds[0] >= 11 and set(rounds[1:]) == {0}
