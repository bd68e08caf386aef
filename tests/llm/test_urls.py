import re

import numpy as np
import xxhash

from starweave.llm import urls


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=None)


def check(rows, pages):
    assert sorted(str((r.page_id, r.host, r.path)) for r in rows) == sorted(str((p, *split(u))) for p, u in pages)
    for r in rows:
        want = rule(r.host, r.path)
        assert r.rule == (want[0] if want else None)
        assert r.verdict == (want[1] if want else "block" if r.score >= 0.5 else "allow")


def test_query(spark, sf):
    check(urls.op2_url_filter(spark, sf).collect(), [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()])


def test_edges(spark):
    given = [None, "", "no scheme", "://", "http://", "http://A.Example.COM/en/x?y#z", "x://www.example.com/en/", "x://net/es/#", "x://badnet/es/", "x://a.net?/fr/", "x://É.net/fr/\nq", "x://a.com", "h://" + "p" * 20_000 + ".org/" + "q/" * 9_000]
    pages = [(k or None, u) for k, u in enumerate(given)] * 2
    df = spark.createDataFrame([(*p, "h", 1.0) for p in pages], "page_id long, url string, host string, score double")
    check(urls.judge(df, urls.labelled_table(spark)).collect(), pages)
    assert urls.judge(df.where("false"), urls.labelled_table(spark)).count() == 0


def words_of_host(url):
    return tuple(re.search(r"(\w+)-(\w+)\.example", url).groups())


def test_held_out_hosts(spark):
    """Every fourth host is left out of the training with all its urls, and judged."""
    rows = urls.labelled_urls()
    hosts = sorted({words_of_host(u) for u, _ in rows})
    held = set(hosts[::4])
    train, test = [r for r in rows if words_of_host(r[0]) not in held], [r for r in rows if words_of_host(r[0]) in held]
    assert len(test) == 2 * len(held)
    # the paths tell the classes too, so those of the held-out hosts are made alike
    test = [(re.sub(r"(example\.\w+)/.*", r"\1/", u), y) for u, y in test]
    weights, bias = urls.train(spark.createDataFrame(train, "url string, label int"))
    scored = spark.createDataFrame(test, "url string, label int").select("label", urls.score(*urls.host_and_path(urls.F.col("url")), weights, bias).alias("p")).collect()
    assert sum((r.p >= 0.5) == bool(r.label) for r in scored) / len(scored) >= 0.9


def grams(url, buckets=urls.BUCKETS):
    """The hash buckets of a url's n-grams: letters hashed one after the other, seeded by the field."""
    out = set()
    for field, text in enumerate(split(url)):
        c = f"^{text}$"
        for n in urls.SIZES:
            for i in range(len(c) - n + 1):
                h = xxhash.xxh64_intdigest(field.to_bytes(4, "little"), 42)
                for letter in c[i : i + n]:
                    h = xxhash.xxh64_intdigest(letter.encode(), h)
                out.add((h - 2**64 if h >= 2**63 else h) % buckets)
    return sorted(out)


def test_regression_by_hand(spark):
    """Weights, bias and every page's score against a regression of our own in primal form, step by step."""
    rows = sorted((y, sorted(grams(u))) for u, y in urls.labelled_urls())
    x = np.zeros((len(rows), urls.BUCKETS))
    for k, (_, g) in enumerate(rows):
        x[k, g] = 1 / np.sqrt(len(g))
    y = np.array([r[0] for r in rows], dtype=float)
    w, b, alpha = np.zeros(urls.BUCKETS), 0.0, np.zeros(len(rows))
    for _ in range(urls.STEPS):
        # the dual weights are what each url has added to the primal ones so far
        alpha += urls.RATE * (y - 1 / (1 + np.exp(-(x @ w + b))) - urls.SHRINK * alpha) / 4
        w, b = x.T @ alpha, alpha.sum()
    weights, bias = urls.train(urls.labelled_table(spark))
    assert np.allclose(weights, w)
    assert np.isclose(bias, b)
    given = ["http://free-pills.example.org/buy", "https://www.city-maps.example.com/about?x", None, "no scheme", "http://É.net/a", "http://x"]
    got = urls.judge(spark.createDataFrame(list(enumerate(given)), "page_id int, url string"), urls.labelled_table(spark)).collect()
    for r in got:
        g = grams(given[r.page_id])
        assert np.isclose(r.score, 1 / (1 + np.exp(-(sum(w[i] for i in g) / np.sqrt(max(1, len(g))) + b))))
