import pytest

TRICKY = [
    (1, "Alpha beta gamma.\n" * 30 + "All rights reserved. CC BY", "en", "src0", 0),
    (2, None, None, None, None),
    (3, "", "en", "src0", 0),
    (None, "a document without an id " * 40, "en", "src1", 9),
    (5, "Alpha beta gamma.\n" * 30 + "All rights reserved. CC BY", "en", "src0", 0),
    (5, "Alpha beta gamma.\n" * 30 + "All rights reserved. CC BY", "en", "src0", 0),
    (6, "ÀÉ naïve café İstanbul ςΣ 中文字 \x00 \x1f   it's we'll", "fr", "src2", 1),
    (7, "the general public license, the GENERAL  public-license " * 3, "en", "src0", 2),
    (8, " \t\n ", "en", "src0", 3),
    (9, "x" * 70_000 + " " + "word " * 30_000, "en", "src0", 3),
    (10, "one two", "en", "src0", 3),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash with internal ones."""
    rows = [(*r, "x", 1, 2.0) for r in TRICKY]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, _id int, score double")


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
