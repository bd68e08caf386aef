"""Quality and toxicity of documents by hierarchical empirical Bayes.

A document's own evidence comes from logistic regressions on its shape and on the log-odds of significant words. They are
fitted on a sample of at most ``MOST_LABELLED`` labelled documents (by a hash of doc_id). All documents then add to the
rates of their host (``source``) and path (``lang`` within the host): known labels count as such, others by their
predicted probability. A sparse path is shrunk toward its host and a sparse host toward the global rate; the strengths
of the priors are estimated from the spread of the rates themselves (method of moments). The posterior of a document
adds to its own log-odds those of its path against the global rate, where the path's and the host's rates leave the document
itself out: its evidence counts once.

* null text is empty and has the evidence of an empty document; null host and path are a host and a path of their own.
* null labels are no labels; of repeated labels the largest counts. Repeated documents are scored and counted each.
* without any labels, or with one class only, the evidence is zero and probabilities are the smoothed rates.
* ties in the order of the sample go by doc_id; documents that repeat a labelled id count in the sample up to ``MOST_ROWS`` rows.
* very long texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import doc_id, keep, keyed, table

MOST_LABELLED = 20_000
MOST_WORDS = 4000
LEAST_DOCUMENTS, LEAST_Z = 8, 6.0
#: Rows that the regressions are fitted on at most: the sample's documents, should their ids repeat.
MOST_ROWS = 4 * MOST_LABELLED
TARGETS = ("quality", "toxic")
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPER = bytes(range(65, 91))
EDGES = ".,;:!?\"'()[]%*#$&|"


def words_in(text: str) -> set[str]:
    return {w.strip(EDGES) for w in text.lower().split()} - {""}


def evidence(text: str, lexicon: dict[str, tuple[float, float]]) -> list[float]:
    """The numbers that the regressions see."""
    tokens = text.split()
    n = max(1, len(tokens))
    raw = text.encode()
    letters = len(raw) - len(raw.translate(None, LETTERS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    blank = sum(len(raw.split(w)) - 1 for w in (b" ", b"\n"))
    ends = sum(t[-1] in "%*#$&!|" for t in tokens)
    distinct = words_in(text)
    out = [
        math.log1p(len(tokens)), (len(raw) - letters - blank) / max(1, len(raw)), upper / max(1, letters), len(set(tokens)) / n,
        len(distinct) / math.sqrt(n), letters / n / 10, ends / n, raw.count(b"\n") / n, float(not tokens),
    ]
    for k in range(len(TARGETS)):
        weights = [lexicon[w][k] for w in distinct if w in lexicon]
        high = [x for x in weights if x > 0]
        out += [max(high, default=0.0), math.log1p(len(high)), min(weights, default=0.0)]
    return out


def lexicon_of(labelled: DataFrame) -> dict[str, tuple[float, float]]:
    """Words that go with a label significantly: word -> log-odds for each target. At most ``MOST_WORDS`` for each."""
    y = [F.col(t) for t in TARGETS]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row = [], []
            for k, text in enumerate(batch.column(0).to_pylist()):
                own = words_in(text)
                words += own
                row += [k] * len(own)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[batch.column(i + 1).take(at) for i in range(len(TARGETS))]], ["word", *TARGETS])

    words = labelled.select("_text", *TARGETS).mapInArrow(split, "word string, quality int, toxic int")
    counts = words.groupBy("word").agg(*[F.count(c).alias(f"n_{t}") for c, t in zip(y, TARGETS, strict=True)], *[F.sum(c).alias(f"k_{t}") for c, t in zip(y, TARGETS, strict=True)])
    counts = keep(counts.where(F.greatest(*[F.col(f"n_{t}") for t in TARGETS]) >= LEAST_DOCUMENTS), "words")
    rate = labelled.agg(*[F.avg(t).alias(t) for t in TARGETS]).first()
    out: dict[str, list[float]] = {}
    for k, t in enumerate(TARGETS):
        p = rate[t]
        if p is None or not 0 < p < 1:
            continue
        n, hits = F.col(f"n_{t}"), F.col(f"k_{t}")
        z = (hits - n * p) / F.sqrt(n * (p * (1 - p)))
        odds = F.log((hits + 0.5) / (n - hits + 0.5)) - math.log(p / (1 - p))
        for r in counts.where(n >= LEAST_DOCUMENTS).where(F.abs(z) >= LEAST_Z).orderBy(F.desc(F.abs(z)), "word").limit(MOST_WORDS).select("word", odds.alias("w")).collect():
            out.setdefault(r.word, [0.0] * len(TARGETS))[k] = r.w
    return {w: tuple(x) for w, x in out.items()}


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method: bias, then weights of the columns."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], shrink)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_rows: int = MOST_ROWS) -> dict:
    """The document classifier: lexicon, and for each target (mean, scale, weights), or None without two classes."""
    sample = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(t).cast("int").alias(t) for t in TARGETS])
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(most)  # the bound of the sample
    labelled = keep(keyed(docs).join(F.broadcast(sample), "_id").select("_id", "_text", *TARGETS), "labelled")
    lexicon = lexicon_of(labelled)
    width = len(evidence("", lexicon))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [evidence(t, lexicon) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64())), *batch.columns[3:]], ["_id", "_tag", "x", *TARGETS])

    numbers = labelled.select("_id", F.xxhash64("_text").alias("_tag"), "_text", *TARGETS).mapInArrow(rows, "_id long, _tag long, x array<double>, quality int, toxic int")
    got = numbers.orderBy("_id", "_tag").limit(most_rows).select("x", *TARGETS).toPandas()  # numbers alone, as many as the bound says
    model: dict = {"lexicon": lexicon}
    for t in TARGETS:
        own = got[got[t].notna()]
        y = own[t].to_numpy(dtype=float)
        if len(y) == 0 or y.min() == y.max():
            model[t] = None
            continue
        x = np.array(own["x"].tolist(), dtype=float).reshape(-1, width)
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        model[t] = (mean, scale, fit((x - mean) / scale, y))
    return model


def document_evidence(docs: DataFrame, model: dict) -> DataFrame:
    """``_id``, ``_tag``, host, path and the log-odds of each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([evidence(t, model["lexicon"]) for t in batch.column(4).to_pylist()])
            z = []
            for t in TARGETS:
                if model[t] is None or not len(x):
                    z.append(pa.array(np.zeros(len(x))))
                else:
                    mean, scale, w = model[t]
                    z.append(pa.array(np.clip(((x - mean) / scale) @ w[1:] + w[0], -15, 15)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *z], ["_id", "_tag", "host", "path", *[f"z_{t}" for t in TARGETS]])

    rows = keyed(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("path"))
    return rows.select("_id", "_tag", "host", "path", "_text").mapInArrow(run, "_id long, _tag long, host string, path string, z_quality double, z_toxic double")


def prior_strength(rates: DataFrame, rate: str, n: str) -> float:
    """How many observations a prior counts for, by the method of moments over groups."""
    r = rates.agg(
        (F.sum(F.col(rate) * F.col(n)) / F.sum(n)).alias("mu"), F.sum(n).alias("total"), F.count(F.lit(1)).alias("groups"), F.sum(F.col(n) * F.col(n)).alias("squares"),
        F.sum(F.col(n) * F.col(rate) * F.col(rate)).alias("second"),
    ).first()
    if not r.total or r.groups < 2:
        return 10.0
    within = r.mu * (1 - r.mu)
    between = (r.second - r.total * r.mu**2 - (r.groups - 1) * within) / max(1e-9, r.total - r.squares / r.total)
    return float(min(1e4, max(2.0, within / between - 1))) if between > 1e-9 else 1e4


def logit(p):
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds p_quality and p_toxic to the rows of ``document_evidence`` (kept as a table).

    The rates join the rows on host and path: by a broadcast where Spark finds them small, else by an exchange, in which it
    splits the rows of a frequent host.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(t).cast("double").alias(f"y_{t}") for t in TARGETS])
    rows = scored.join(known, "_id", "left")
    own = {t: F.coalesce(F.col(f"y_{t}"), 1 / (1 + F.exp(-F.col(f"z_{t}")))) for t in TARGETS}
    rows = keep(rows.select("_id", "_tag", "host", "path", *[f"z_{t}" for t in TARGETS], *[own[t].alias(f"own_{t}") for t in TARGETS]), "owns")
    paths = keep(rows.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"own_{t}").alias(f"s_{t}") for t in TARGETS]), "paths")
    hosts = keep(paths.groupBy("host").agg(F.sum("n").alias("m"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS]), "hosts")
    total = hosts.agg(F.sum("m").alias("m"), *[F.sum(f"h_{t}").alias(t) for t in TARGETS]).first()
    rates = keep(paths.join(hosts, "host"), "rates")
    both = rows.join(rates, ["host", "path"])
    columns = []
    for t in TARGETS:
        mu = ((total[t] or 0.0) + 1) / ((total["m"] or 0.0) + 2)
        strong = prior_strength(hosts.withColumn("r", F.col(f"h_{t}") / F.col("m")), "r", "m")
        strong_path = prior_strength(paths.withColumn("r", F.col(f"s_{t}") / F.col("n")), "r", "n")
        one = F.col(f"own_{t}")
        host = (F.col(f"h_{t}") - one + strong * mu) / (F.col("m") - 1 + strong)
        path = (F.col(f"s_{t}") - one + strong_path * host) / (F.col("n") - 1 + strong_path)
        shift = logit(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), path))) - math.log(mu / (1 - mu))
        columns.append((1 / (1 + F.exp(-(F.col(f"z_{t}") + shift)))).alias(f"p_{t}"))
    return both.select("_id", "_tag", *columns)


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``_id``, ``_tag``, p_quality, p_toxic and ``keep``: likely of good quality and not likely toxic."""
    scored = keep(document_evidence(docs, train(docs, labels, most)), "evidence")
    return posteriors(scored, labels).withColumn("keep", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(doc_id(), F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), "keep")
