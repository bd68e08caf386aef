import hashlib
import random

from starweave.llm import linededup


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def xx(value, seed=42):
    import xxhash

    raw = value.encode() if isinstance(value, str) else (value % 2**64).to_bytes(8, "little")
    return signed(xxhash.xxh64_intdigest(raw, seed % 2**64))


def chunks(text):
    lines = text.split("\n")
    h = [xx(x) for x in lines]
    r = [xx(h[i + 1], xx(h[i])) for i in range(len(h) - 1)]
    cuts = [0, *[i for i in range(1, len(lines) - 2) if r[i] < r[i - 1] and r[i] < r[i + 1]], len(lines)]
    return [(b - a, "\n".join(lines[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def brute(rows):
    rows = [(2**63 - 1 if d is None else d, xx(t or ""), t or "") for d, t in rows]
    first = {}
    for d, tag, text in rows:
        for k, (n, c) in enumerate(chunks(text)):
            if n >= 2 and c.strip(" \t\n\x0b\f\r"):
                first[c] = min(first.get(c, (d, tag, k)), (d, tag, k))
    out = []
    for d, tag, text in rows:
        keep = [(n, c) for k, (n, c) in enumerate(chunks(text)) if not (n >= 2 and c.strip(" \t\n\x0b\f\r") and first[c] != (d, tag, k))]
        kept = "\n".join(c for _, c in keep)
        total, lost = len(chunks(text)), len(chunks(text)) - len(keep)
        lines = sum(n for n, _ in chunks(text))
        out.append((None if d == 2**63 - 1 else d, lines, total, lost, lines - sum(n for n, _ in keep), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(rows):
    return sorted(map(tuple, rows), key=str)


def test_query(spark, sf, documents):
    assert got(linededup.op7_line_dedup(spark, sf).collect()) == brute(documents)


def test_edges(spark, tricky, empty, tmp_path):
    rng = random.Random(2)
    block = "\n".join(f"line {rng.random()}" for _ in range(12))
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    rows += [(100 + k, f"own {k}\n{block}\n" + "\n".join(f"tail {k} {i}" for i in range(rng.randrange(5)))) for k in range(8)] + [(90, "\n\n\n\n"), (93, "\n\n\n\n"), (94, "\t\n\t\n\t\n"), (95, "\t\n\t\n\t\n"), (91, "same\n" * 9), (92, "same\n" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(linededup.op7_line_dedup(spark, str(tmp_path)).collect()) == brute(rows)
    kept = linededup.dedup_lines(tricky)
    assert set(tricky.columns) <= set(kept.columns)
    assert linededup.dedup_lines(empty).count() == 0


def test_shifted_passages_lose_all_but_their_edges(spark):
    rng = random.Random(7)
    block = [f"passage {rng.random()}" for _ in range(30)]
    docs = [(k, "\n".join([f"before {k} {i}" for i in range(k)] + block + [f"after {k}"])) for k in range(5)]
    out = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r._gone_lines >= 20 for r in out if r.doc_id)
    assert next(r._gone_lines for r in out if r.doc_id == 0) == 0
