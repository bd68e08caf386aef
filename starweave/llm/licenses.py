"""Licence scans by a positional index of rare tokens (built-in functions only).

The index holds, for each word of the licence phrases, its postings: (phrase, offset). A scan has two steps:

1. one pass over each document's words leaves its licence words alone, with their positions; from these the document
   frequencies of all licence words are counted, over all documents;
2. per file, the licence words of highest inverse document frequency are looked up: of each phrase whose words the file has, the
   rarest. A hit at position ``i`` posts (phrase, ``i`` - offset); postings of one relative position are one candidate, where
   every word of the phrase is then verified. As all words of a phrase are licence words, they follow each other among the
   file's licence words too, so this needs no further look at the text.

A template is a set of key phrases: it is recognised where its mandatory phrases are verified, within a distance of each other.

* null text is empty: no words, no labels, score 0.
* a repeated row is scanned again; a null doc_id is kept; ties of document frequency go by the order of words in a phrase.
* very long texts are scanned whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import ascii_lower, bind, keep, table

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of the method: label -> (mandatory key phrases, supporting phrases, words that these may lie apart).
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[str, ...], int]] = {
    "mit": (("permission is hereby granted", "free of charge"), ("the software is provided as is", "without warranty of any kind"), 200),
    "apache-2": (("apache license", "version 2 0"), ("apache org licenses license 2 0", "on an as is basis"), 200),
    "bsd": (("redistribution and use in source and binary forms",), ("with or without modification", "neither the name of"), 300),
    "mpl-2": (("mozilla public license",), ("v 2 0", "version 2 0"), 60),
    "lgpl": (("lesser general public license",), ("free software foundation",), 200),
    "agpl": (("affero general public license",), ("free software foundation",), 200),
    "gpl-notice": (("general public license", "free software foundation"), ("either version", "any later version"), 300),
    "cc-by-sa": (("cc by sa",), ("share alike", "sharealike"), 60),
    "cc-by-nc": (("cc by nc",), ("noncommercial", "non commercial"), 60),
    "cc0": (("cc0",), ("public domain",), 60),
    "unlicense": (("released into the public domain",), ("unencumbered software",), 200),
    "spdx": (("spdx license identifier",), (), 10),
}

WORD_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; gaps at either end make no word."""
    trimmed = F.regexp_replace(ascii_lower(text), f"^{WORD_GAPS}|{WORD_GAPS}\\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAPS))


def phrases() -> list[str]:
    found = dict.fromkeys(BASE)
    for mandatory, supporting, _ in TEMPLATES.values():
        found.update(dict.fromkeys((*mandatory, *supporting)))
    return list(found)


#: The licence words; in the table of hits each is one character.
VOCABULARY = sorted({w for p in phrases() for w in p.split()})
CODES = {w: chr(0x30 + k) for k, w in enumerate(VOCABULARY)}


def coded(phrase: str) -> str:
    return "".join(CODES[w] for w in phrase.split())


def hits(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, and the licence words of each document: ``places`` (positions from 0) and ``codes``."""
    empty = F.array().cast("array<int>")
    licence_words = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(VOCABULARY))
    code_of = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])

    def of(w: Column) -> Column:
        return bind(F.when(F.size(w) > 0, licence_words(w)).otherwise(empty), lambda p: F.struct(F.size(w).alias("n_words"), p.alias("places"), F.array_join(F.transform(p, lambda i: code_of[F.get(w, i)]), "").alias("codes")))

    return docs.select("doc_id", bind(words_of(F.coalesce(F.col("text"), F.lit(""))), of).alias("x")).select("doc_id", "x.*")


def document_frequencies(found: DataFrame) -> dict[str, int]:
    """In how many of all documents each licence word occurs: one row for each word comes to the driver."""
    rows = found.where("codes != ''").select(F.explode(F.array_distinct(F.split("codes", ""))).alias("c")).groupBy("c").count().collect()
    n = {r["c"]: r["count"] for r in rows}
    return {w: n.get(c, 0) for w, c in CODES.items()}


def verified(frequency: dict[str, int]) -> Column:
    """Array of (phrase, hit): where each phrase begins among the file's hits, every word verified."""
    every = [coded(p) for p in phrases()]
    rarest = [min(range(len(c)), key=lambda k, p=p: (frequency[p.split()[k]], k)) for p, c in zip(phrases(), every, strict=True)]
    index = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(len(c)).alias("long"), F.lit(c[r]).alias("rare")) for c, r in zip(every, rarest, strict=True)])
    postings: dict[str, list] = {}
    for k, c in enumerate(every):
        for offset, letter in enumerate(c):
            postings.setdefault(letter, []).append(F.struct(F.lit(k).alias("phrase"), F.lit(offset).alias("offset")))
    posting_of = F.create_map(*[x for letter, found in postings.items() for x in (F.lit(letter), F.array(*found))])
    codes, places = F.col("codes"), F.col("places")
    # of each phrase that the file has all words of, the word of highest inverse document frequency
    have = F.array_distinct(F.split("codes", ""))
    possible = lambda of: F.filter(F.array(*[F.when(F.size(F.array_except(F.split(F.lit(c), ""), of)) == 0, F.lit(c[r])) for c, r in zip(every, rarest, strict=True)]), lambda x: x.isNotNull())
    looked_up = bind(have, lambda h: F.array_distinct(possible(h)))
    letter = lambda k: F.substr(codes, k + 1, F.lit(1))
    at = bind(looked_up, lambda words: F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda k: F.array_contains(words, letter(k)))).otherwise(F.array().cast("array<int>")))
    posted = lambda k: F.transform(posting_of[letter(k)], lambda q: F.struct(q["phrase"].alias("phrase"), (k - q["offset"]).alias("hit")))
    candidates = F.array_distinct(F.flatten(F.transform(at, posted)))

    def holds(c: Column) -> Column:
        first, long = c["hit"], F.get(index, c["phrase"])["long"]
        in_order = F.substr(codes, first + 1, long) == F.get(index, c["phrase"])["code"]
        return (first >= 0) & in_order & F.coalesce(F.get(places, first + long - 1) - F.get(places, first) == long - 1, F.lit(False))

    return F.when(codes == "", F.array().cast("array<struct<phrase:int,hit:int>>")).otherwise(F.filter(candidates, holds))


def scan(docs: DataFrame, frequency: dict[str, int] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, the places of base phrases, base and method labels, and a score."""
    found = keep(hits(docs), "hits")
    frequency = document_frequencies(found) if frequency is None else frequency
    all_phrases = phrases()
    met = found.select("doc_id", "n_words", "places", verified(frequency).alias("v"))
    starts = lambda k: F.array_sort(F.transform(F.filter("v", lambda x: x["phrase"] == k), lambda x: F.get("places", x["hit"])))
    posted = met.select("doc_id", "n_words", *[starts(k).alias(f"p{k}") for k in range(len(all_phrases))])
    at = {p: F.col(f"p{k}") for k, p in enumerate(all_phrases)}

    def near(key: Column, other: Column, apart: int) -> Column:
        return F.exists(key, lambda i: F.exists(other, lambda j: F.abs(i - j) <= apart))

    labels, strengths = [], []
    for phrase, label in BASE.items():
        hit = F.size(at[phrase]) > 0
        labels.append(F.when(hit, F.lit(label)))
    for label, (mandatory, supporting, apart) in TEMPLATES.items():
        first = at[mandatory[0]]
        hit = F.size(first) > 0
        for other in mandatory[1:]:
            hit = hit & (F.size(at[other]) > 0) & near(first, at[other], apart)
        labels.append(F.when(hit, F.lit(label)))
        if supporting:
            share = sum((F.when((F.size(at[s]) > 0) & near(first, at[s], apart), 1.0).otherwise(0.0) for s in supporting), F.lit(0.0)) / len(supporting)
            strengths.append(F.when(hit, 0.7 + 0.3 * share).otherwise(0.0))
        else:
            strengths.append(F.when(hit, 1.0).otherwise(0.0))
    n_base = len(BASE)
    base_score = F.when(F.size(F.array_compact(F.array(*labels[:n_base]))) > 0, 0.5).otherwise(0.0)
    base_places = F.concat(*[at[p] for p in BASE])
    return posted.select(
        "doc_id",
        "n_words",
        base_places.alias("base_places"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels[:n_base])))).alias("base_labels"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("labels"),
        F.greatest(base_score, *strengths).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
