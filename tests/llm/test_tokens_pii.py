"""Token counts against the library; personal data against a plain scanner."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tablemill.llm import pii, tokens

FOLDER = "/root/testdata/sf0.001"
HARD = ["", None, " ", "a  b\n\n c", "it's  we're\t\tx", "<|endoftext|> and <|endoftext|>", "é ê ü x", "日本 語 text", "x" * 5_000, "word " * 30_000, "word " * 30_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts_are_the_librarys(spark, library):
    texts = HARD + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    rows = [(i, t, "extra", 7) for i, t in enumerate(texts)] + [(0, "", "extra", 7), (None, "null id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string, N_TOKENS int")
    got = tokens.count_tokens(df)
    assert got.columns == ["doc_id", "text", "other", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(rows)
    for r in got.collect():
        text = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), library(text)) and r.over_limit == (r.n_tokens > 1024)


def test_the_cache_is_used_and_appended_to(spark, tmp_path):
    schema, cache = "doc_id long, text string", str(tmp_path / "counts")
    tokens.count_tokens(spark.createDataFrame([(1, "one two"), (2, "three"), (3, "three")], schema), cache=cache).collect()
    stored = spark.read.parquet(f"{cache}/{tokens.tokenizer_version(tokens.default_tokenizer())}")
    assert stored.count() == 2
    false_count = stored.select("digest", F.lit(99).cast("long").alias("n_tokens")).where(F.col("digest") == F.unhex(F.sha2(F.lit("three"), 256)))
    false_count.write.mode("append").parquet(f"{cache}/{tokens.tokenizer_version(tokens.default_tokenizer())}")  # a second entry: the smaller one holds
    again = tokens.count_tokens(spark.createDataFrame([(4, "three"), (5, "four")], schema), cache=cache).collect()
    assert {r.doc_id for r in again} == {4, 5}
    assert spark.read.parquet(f"{cache}/{tokens.tokenizer_version(tokens.default_tokenizer())}").count() == 4


def test_no_texts_no_counts(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def plain_spans(text):
    found = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, rank, pattern in (("card", 2, CARD), ("phone", 3, PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (12 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 9 <= len(digits) <= 15:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


PII_TEXTS = [
    None, "", "no data", "a@b.c@d.e x@y", "a@b.cd%x@y.z _a@b.co..", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111 5", "+1 (017) 555-7713 +49.30.1234567- +1 2", "é\U0001f600 mail é.x@y.org 10.0.0.1\n+44 20 7946 0958",
    "\u0001a@b.co\u0001 10.0.0.1\u0001", "7" * 20_000, "a" * 30_000 + "@" + "b" * 10_000 + ".c", "1 " * 20_000, "+1" * 5_000, "a@1.2.3.4 4539578763621486", "0000 0000 0000 0000.0.0.0",
]


def test_pattern_spans_match_a_plain_scanner(spark):
    rows = [(i, t) for i, t in enumerate(PII_TEXTS)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in got:
        assert [(s.start, s.rank, s.kind, s.end) for s in r.s] == plain_spans(PII_TEXTS[r.i] or ""), PII_TEXTS[r.i][:60]


def test_terms_that_give_an_entity_away_are_replaced(spark):
    near = [(i, f"line {i} pelican keeper mail jo@zoo.example today and {w}", "s", None) for i, w in enumerate(["one", "two", "three", "four"])]
    far = [(10 + i, f"common words and today number {i} of the keeper without it", "s", None) for i in range(300)]
    odd = [(None, "the Pelican is here", None, None), (400, None, None, None), (401, "", "s", 1), (401, "", "s", 1)]
    docs = spark.createDataFrame(near + far + odd, "doc_id long, text string, source string, pii_text long")
    got = {(r.doc_id, r.text): r for r in pii.sanitise(docs).collect()}
    assert len(got) == len(near) + len(far) + 3 and pii.sanitise(docs).count() == len(near) + len(far) + 4
    first = got[(0, near[0][1])]
    assert [s.kind for s in first.pii_spans] == ["term", "term", "term", "email"] and [s.kind for s in first.pii_base] == ["email"]
    assert first.pii_text == " 0 [email context] keeper  [EMAIL] today and one"  # terms that occur with it alone go, one that mostly does is generalised
    alone = got[(None, "the Pelican is here")]
    assert [(s.kind, s.start, s.end) for s in alone.pii_spans] == [("term", 4, 11)] and "Pelican" not in alone.pii_text
    assert got[(400, None)].pii_text == "" and got[(401, "")].pii_spans == []
    assert got[(10, far[0][1])].pii_text == far[0][1]


def test_overlapping_spans_share_a_label(spark):
    docs = spark.createDataFrame([(1, "x a@1.2.3.4, 4539578763621486 y")], "doc_id long, text string")
    row = pii.sanitise(docs).first()
    assert row.pii_text == "x [EMAIL], [CARD] y" and [s.kind for s in row.pii_spans] == ["email", "ip", "card"]
    assert pii.sanitise(docs.where("doc_id = 2")).count() == 0


def test_query_over_the_documents(spark):
    from tablemill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op1_pii"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        listed = [f"{k}:{s}:{e}" for s, _, k, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
