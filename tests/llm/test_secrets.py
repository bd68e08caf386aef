import hashlib
import random
import re
import string
import uuid

import pytest

from starweave.llm import secrets

PATTERNS = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base_by_hand(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.A | (re.I if kind == "assign" else 0)):
            long = len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)
            if long:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def checked(rows, texts):
    for r in rows:
        want = base_by_hand(texts[r.doc_id])
        counts = [sum(w.startswith(kind) for w in want) for kind in PATTERNS]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("random")] == want
        key = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])) for s in every]
        assert key == sorted(key)


def test_query(spark, sf, documents):
    rows = secrets.op11_secret_scan(spark, sf).collect()
    assert len(rows) == len(documents)
    checked(rows, dict(documents))


HARD = [
    'token=token=abcdef', 'token="api_key": "abcdefgh"', "PassWord : 'xyz' secret=abcdef", "ſecret=abcdefgh Token=abcdefgh", "API_KEY==== apikey:'0123456789abcdef01234567'",
    "é" * 50 + "AKIA" + "A" * 16 + " AKIAAKIA " + "é 中 " + "f" * 24 + "g" + "0" * 23, "𝒳 token: '𝒳' token:   abc.def=", "x" * 70_000 + "deadbeef" * 20, "secret\n=\nabcdefgh secret =\tabcdefg", "", None,
]


def test_base_patterns_of_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    rows = secrets.secret_spans(df, kept=("doc_id",)).collect()
    for r in rows:
        got = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "random"]
        assert got == base_by_hand(HARD[r.doc_id]), HARD[r.doc_id]


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.vocabulary("byte_bpe_50k"))


def test_random_strings_are_found_and_words_are_not(scanner, documents):
    """Held-out accuracy: keys of several alphabets against words, identifiers and digests."""
    rng = random.Random(5)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-"]
    keys = ["".join(rng.choice(a) for _ in range(rng.randint(24, 64))) for a in alphabets for _ in range(200)]
    found = sum(bool(scanner.spans(f"use {k} here".encode())) for k in keys)
    assert found >= 0.97 * len(keys)
    words = ["internationalization_of_configuration", "com/example/project/src/main/java/Application", "HttpServletRequestWrapperFactoryBean", "2024-01-02-12-33-44-000000", "user_account_settings_page_2",
             "Donaudampfschifffahrtsgesellschaft", "some-slug-of-an-article-about-things-123456", "________________________", "------------------------------", "====================", "1234567890123456789012"]
    assert not [w for w in words if scanner.spans(f"see {w} there".encode())]
    noise = [t for _, t in documents if not base_by_hand(t)]
    flagged = [t for t in noise if scanner.spans(t.encode())]
    assert len(flagged) <= 0.005 * len(noise)


def test_known_digests_and_identifiers_are_left_out(scanner):
    rng = random.Random(6)
    for n in (40, 64):
        digest = "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
        assert not scanner.spans(f"commit {digest}.".encode())
    assert not scanner.spans(f"id {uuid.UUID(int=rng.getrandbits(128))} end".encode().upper())
    blob = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(43))
    assert not scanner.spans(f'"integrity": "sha256-{blob}="'.encode()) and not scanner.spans(f"md5: {blob}".encode())
    assert [s[1] for s in scanner.spans(f"key {blob}".encode())] == [3]
    assert [s[1] for s in scanner.spans(f"token={blob}".encode())] == [0]  # a pattern has it already


def test_ratio_by_hand(scanner):
    text = b"the key is zQ8x1Jv0TnWq7Lk2Rb9Yd4 and the word is uncharacteristically"
    ids = scanner.encode("zQ8x1Jv0TnWq7Lk2Rb9Yd4")
    assert 22 < secrets.RATIO * len(ids)
    assert scanner.spans(text) == [(11, 3, 33)]


def test_edges(spark, tricky, empty):
    out = secrets.secret_spans(tricky)
    assert out.columns == [*tricky.columns, "spans"] and out.count() == tricky.count()
    assert secrets.secret_spans(empty).count() == 0
    clash = tricky.withColumnRenamed("fp", "_own_raw").withColumnRenamed("source", "_own_clean")
    assert secrets.redacted(clash).columns == clash.columns
    assert sorted(map(str, secrets.redacted(tricky).collect())) == sorted(map(str, tricky.collect()))


def test_redaction(spark):
    key = "é AKIA" + "B" * 16 + " ü token = 'abcdefgh' end"
    df = spark.createDataFrame([(1, key), (2, None), (3, "é plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert got == {1: "é [access] ü [assign]' end", 2: None, 3: "é plain"}
