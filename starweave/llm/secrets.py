"""Secret scan: three fixed patterns, and random strings by a token-efficiency test.

A tokenizer's vocabulary has long pieces for what people write and short ones for the rest. So a run of characters that
takes many tokens for its length is likely random: a key, a password, a session. The runs tested are those of
letters, digits and ``+/_-`` with up to two ``=`` at the end, of ``SHORTEST`` characters at least. Not tested are

* known digests: hexadecimal of a digest's length, or any run that a digest's name introduces (``sha256-``, ``md5:``);
* known identifiers: UUIDs, numbers and dates, and runs whose parts between ``-_/`` are all plain words or short numbers;
* what lies inside a span that a pattern has found already.

Every pattern's spans stay, whatever the test says. All patterns are of ASCII characters, so texts are searched as bytes
and only the spans are counted in code points.

* null text is empty and has no spans; repeated rows and ties have one answer each; a null doc_id is kept.
* very long texts are searched whole. An empty table gives no rows; extra columns are ignored by the query and kept by
  ``secret_spans`` and ``redacted``, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from starweave.llm.common import free_names, table

# The patterns of the base scan, over lower-cased text for the first, and the least lengths of what they find.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
# Characters of the digests MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGESTS = (32, 40, 56, 64, 96, 128)

#: The shortest run that is tested: below it the ratio says too little.
SHORTEST = 20
#: Runs of fewer characters for each token than this are random. Prose has 4 or more, invented words 2.2 or more, random ones 1.3 to 1.7.
RATIO = 1.8

RUN = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
DIGEST = re.compile(rb"|".join(rb"[0-9a-f]{%d}|[0-9A-F]{%d}" % (n, n) for n in DIGESTS))
NAMED = re.compile(rb"(?:sha-?(?:1|224|256|384|512)|md5|blake[23][bs]?|crc32|integrity|etag)[\"']?[-:=_\x20]+[\"']?$", re.I)
INTRODUCED = re.compile(rb"(?:sha-?(?:1|224|256|384|512)|md5|blake[23][bs]?)[-_]", re.I)
UUID = re.compile(rb"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
PART = rb"(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15}|[0-9]{1,14})"
NAME = re.compile(rb"[-_/]*%b(?:[-_/]+%b)+[-_/]*|[0-9_/-]+" % (PART, PART))

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def encoding(ranks_path: str) -> tiktoken.Encoding:
    """A byte-level vocabulary by its file of ranks."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Scanner:
    """The spans of one text after another; a worker has one."""

    def __init__(self, ranks_path: str, ratio: float = RATIO):
        self.encode, self.ratio = encoding(ranks_path).encode_ordinary, ratio
        self.assign, self.access, self.hex = map(re.compile, (ASSIGN, ACCESS, HEX))

    def base(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) in bytes, sorted. Matches that fail their least length are used up all the same."""
        out, low = [], text.lower()
        if any(k in low for k in KEYWORDS):
            out += [(m.start(), 0, m.end()) for m in self.assign.finditer(low) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
        if b"AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        out += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(out)

    def random(self, text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for m in RUN.finditer(text):
            a, b, run = m.start(), m.end(), m[0]
            if any(s <= a and b <= e for s, _, e in base):
                continue
            bare = run.rstrip(b"=")
            if DIGEST.fullmatch(bare) or UUID.fullmatch(bare) or NAME.fullmatch(bare) or INTRODUCED.match(run) or NAMED.search(text[max(0, a - 24) : a]):
                continue
            if len(run) < self.ratio * len(self.encode(run.decode())):
                out.append((a, 3, b))
        return out

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        base = self.base(text)
        return sorted(base + self.random(text, base))


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    begins = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    at = np.concatenate([[0], begins])
    return [(int(at[a]), k, int(at[b])) for a, k, b in spans]


def with_spans(texts: DataFrame, text: str, spans: str, clean: str, ranks_path: str, ratio: float) -> DataFrame:
    """``texts`` (any columns, ``text`` as binary) with ``spans`` and ``clean``, the text with each span replaced by its kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks_path, ratio)
        for batch in batches:
            found, out = [], []
            for x in batch.column(text):
                t = x.as_py() or b""
                spans_here = scanner.spans(t)
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in in_code_points(t, spans_here)])
                out.append(hidden(t, spans_here))
            keep = [i for i, n in enumerate(batch.schema.names) if n != text]
            columns = [*[batch.columns[i] for i in keep], pa.array(found, kind), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*[batch.schema.names[i] for i in keep], spans, clean])

    return texts.mapInArrow(run, StructType([*texts.drop(text).schema.fields, StructField(spans, SPANS), StructField(clean, BinaryType())]))


def hidden(text: bytes, spans: list[tuple[int, int, int]]) -> bytes | None:
    """The text with its spans replaced, None where it has none; spans that overlap become one."""
    if not spans:
        return None
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], b"[", KINDS[k].encode(), b"]"]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def vocabulary(name: str) -> str:
    return public_tokenizers.path(f"{name}.tiktoken")


def secret_spans(docs: DataFrame, tokenizer: str = "byte_bpe_50k", ratio: float = RATIO, ranks_path: str | None = None, name: str = "spans", kept: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with ``name``: their spans, an array of (kind, start, end), in code points, sorted by start and kind.

    ``kept`` names the columns that stay, all where it is not given. ``ranks_path`` is where the executors find the vocabulary.
    """
    raw, clean = free_names(docs, "raw", "clean")
    rows = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if kept is None else kept) if c.lower() != name.lower()], F.col("text").cast("string").cast("binary").alias(raw))
    return with_spans(rows, raw, name, clean, ranks_path or vocabulary(tokenizer), ratio).drop(clean)


def redacted(docs: DataFrame, tokenizer: str = "byte_bpe_50k", ratio: float = RATIO, ranks_path: str | None = None) -> DataFrame:
    """The rows with each secret in ``text`` replaced by its kind in brackets; other columns, and null texts, as they are."""
    raw, clean, spans = free_names(docs, "raw", "clean", "spans")
    rows = docs.withColumn(raw, F.col("text").cast("string").cast("binary"))
    found = with_spans(rows, raw, spans, clean, ranks_path or vocabulary(tokenizer), ratio)
    return found.withColumn("text", F.coalesce(F.decode(F.col(clean), "UTF-8"), F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = secret_spans(docs, kept=("doc_id",))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
