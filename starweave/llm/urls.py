"""URL filters (built-in functions only): host and path rules, and a logistic regression for the rest.

The regression works on hashed character n-grams of host and path. It is trained from a small labelled table of URLs
(at most ``MOST_LABELLED`` rows, checked), within one expression: gradient descent on the dual weights of the labelled
URLs, whose kernel is the overlap of their n-gram sets. The primal weights, one for each of ``BUCKETS`` hash buckets, are
then a constant of the scoring expression, so pages are judged in one pass without a shuffle.

* a null url, or one without ``://``, has an empty host and path; no rule fits these, and the method judges them.
* of rules that tie in length the one with the longer host wins, then the first in order; a probability of exactly 0.5 blocks.
* very long urls are judged whole.
* repeated rows are judged again; a null page_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import ascii_lower, bind, keep, table

# The rules, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MOST_RULES = 1000

BUCKETS = 4096
SIZES = (3, 4)
MOST_LABELLED = 1000
STEPS, RATE, SHRINK = 120, 0.5, 0.01

# Words of hosts and paths from which the small labelled table is written.
BAD = (("cheap", "free", "hot", "win", "adult", "bonus"), ("pills", "casino", "money", "deals", "loans", "prizes"))
GOOD = (("city", "open", "school", "garden", "weather", "public"), ("library", "news", "museum", "physics", "records", "maps"))
BAD_PATHS = ("/offer/now", "/buy?click=7")
GOOD_PATHS = ("/articles/history.html", "/about")
ZONES = ("example.com", "example.net", "example.org")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if it is to be blocked)."""
    rows = []
    for label, words, tails in ((1, BAD, BAD_PATHS), (0, GOOD, GOOD_PATHS)):
        for k, (first, second, tail) in enumerate(product(*words, tails)):
            rows.append((f"http{'s' * (k % 2)}://{('', 'www.', 'm.', 'blog.')[k % 4]}{first}-{second}.{ZONES[k % 3]}{tail}", label))
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of a URL: what follows the first ``://`` up to ``/ ? #``, lower-cased; then what follows up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule, as struct(rule, verdict); null if none fits. Rules are a checked, bounded list."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The distinct hash buckets of the n-grams of host and path, each field with its ends marked."""

    def windows(letters: Column, field: int, n: int) -> Column:
        count = F.size(letters) - n + 1
        at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(field), *[F.get(letters, i + j) for j in range(n)]), F.lit(buckets)).cast("int"))

    def of(field: int, text: Column) -> Column:
        letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        return bind(letters, lambda c: F.concat(*[windows(c, field, n) for n in SIZES]))

    return F.array_distinct(F.concat(of(0, host), of(1, path)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """Weights of the buckets and the bias, from (url, label); rows with a null label are ignored."""
    rows = labelled.where("url is not null and label is not null").select("label", grams(*host_and_path(F.col("url")), buckets).alias("g")).where(F.size("g") > 0)
    if rows.limit(MOST_LABELLED + 1).count() > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled urls")
    one = rows.agg(F.sort_array(F.collect_list(F.struct("label", "g"))).alias("x"))
    overlap = lambda a, b: F.size(F.array_intersect(a["g"], b["g"])) / F.sqrt(F.size(a["g"]) * F.size(b["g"])) + 1
    one = keep(one.select("x", F.transform("x", lambda a: F.transform("x", lambda b: overlap(a, b))).alias("kernel")), "kernel")

    def step(alpha: Column, _: Column) -> Column:
        f = F.transform("kernel", lambda row: F.aggregate(F.zip_with(row, alpha, lambda k, a: k * a), F.lit(0.0), lambda s, v: s + v))
        wrong = F.zip_with("x", f, lambda e, z: e["label"] - sigmoid(z))  # f is outside of any lambda: computed once a step
        return F.zip_with(alpha, wrong, lambda a, w: a + RATE * (w - SHRINK * a) / 4)

    one = keep(one.select("x", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("x", lambda _: F.lit(0.0)), step).alias("alpha")), "alpha")
    each = one.select(F.explode(F.arrays_zip("x", "alpha")).alias("e")).select("e.x.g", "e.alpha")
    weights = each.select((F.col("alpha") / F.sqrt(F.size("g"))).alias("w"), F.explode("g").alias("bucket")).groupBy("bucket").agg(F.sum("w").alias("w"))
    table_ = [0.0] * buckets
    for r in weights.collect():  # at most ``buckets`` rows
        table_[r.bucket] = r.w
    bias = each.agg(F.sum("alpha")).first()[0] or 0.0
    return table_, bias


def score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The probability that a URL is to be blocked."""
    w = F.lit(weights)
    z = bind(grams(host, path, len(weights)), lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(w, b)) / F.sqrt(F.greatest(F.size(g), F.lit(1))))
    return sigmoid(z + bias)


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id``, host, path, rule, verdict (the rule's, else the method's) and the method's score."""
    weights, bias = train(labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.col("host"), F.col("path"), weights, bias))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"), "score")


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in labelled_urls()])
    return spark.range(1).select(F.inline(rows))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), labelled_table(spark))
