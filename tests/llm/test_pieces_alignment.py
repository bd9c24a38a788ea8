"""Piece ids against the library; alignment against token ends that are compared one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablemill.llm import alignment, pieces, tokens
from tablemill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
HARD = ["", None, " ", "  a ", "a  b\n\n c", "a\tb\r\n", "▁x▁", "<0x41>", "</s> <s>", "<|endoftext|> x", "日本 語\U0001f600", "ﬁ Å Á ｱ", "\x00\x01 z", "﻿x​y",
        "é ê ü x ÷ y", "x" * 5_000, " " * 100 + "q", "word " * 30_000, "\n" * 50, "a b", "aaaa" * 300]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCodec(pieces.default_model())


def test_ids_are_the_librarys(coder, library):
    rng = random.Random(1)
    letters, own = "ab thein  \n▁é日ｱ1.,-_=", "".join(sorted(coder.alphabet))
    texts = [t or "" for t in HARD]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice(own) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["".join(coder.piece[rng.randrange(259, coder.size)] for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == library.encode(text, add_eos=True), text[:80]
        assert coder.decode(ids) == library.decode(ids), text[:80]


def test_backtracking_equals_merging(coder):
    """Also where nothing is remembered and the longest token must be given up again and again."""
    rng = random.Random(2)
    for _ in range(800):
        text = "".join(rng.choice("▁▁▁thersonaing") for _ in range(rng.randint(1, 30)))
        coder.pairs.clear()
        assert [coder.piece[i] for i in coder.tokens(text)] == coder.merged(text)


def test_any_ids_are_decoded_as_the_library_does(coder, library):
    rng = random.Random(3)
    for _ in range(800):
        ids = [rng.choice([rng.randrange(coder.size), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_memos_stay_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 10)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 10)
    small = pieces.PieceCodec(pieces.default_model())
    for text in ["the quick brown fox jumps over the lazy dog and runs through twelve forests", "another text with the quick words again"] * 3:
        assert small.encode(text) == library.encode(text, add_eos=True)
        assert len(small.memo) <= 10 and len(small.pairs) <= 10


def test_rows_keep_their_place(spark, library):
    rows = [(i, t, 5, "x") for i, t in enumerate(HARD)] + [(None, "null id", 1, None), (0, "", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, PIECE_IDS int, __other string")
    got = pieces.encode_pieces(df)
    assert got.columns == ["doc_id", "text", "__other", "piece_ids", "piece_text"] and got.count() == len(rows)
    for r in got.collect():
        ids = library.encode(r.text or "", add_eos=True)
        assert r.piece_ids == ids and r.piece_text == library.decode(ids)
    assert pieces.encode_pieces(df.where("false")).count() == 0


def brute(rows):
    """Token ends compared one by one, from what the two libraries give for whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tokens = Tokenizer.from_file(tokens.default_tokenizer())
    a_tokens.encode_special_tokens = True
    b_tokens = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    letters = alignment.byte_letters()
    raw_a = {i: bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode() for entry, i in a_tokens.get_vocab().items()}

    def raw_b(i):
        piece = b_tokens.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b_tokens.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for key, text in rows:
        spaced = (" " + text).encode() if text else b""
        a = a_tokens.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tokens.encode(text) if text else []
        if not text or b"".join(raw_a[i] for i in a) != spaced or b"".join(map(raw_b, b)) != spaced:
            found.append((key, 0, 0, [], ""))
            continue
        ends_a, ends_b = (dict(zip(np.cumsum([len(f(i)) for i in ids]).tolist(), range(len(ids)))) for ids, f in ((a, raw_a.get), (b, raw_b)))
        links, groups, x, y = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            i, j = ends_a[end], ends_b[end]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        counts.update(links)
        found.append((key, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(key, n_a, n_b, len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest)
            for key, n_a, n_b, links, digest in found]


def test_alignment_of_hard_texts(spark):
    from pyspark.sql import functions as F

    rows = list(enumerate(HARD)) + [(50, "the same words"), (51, "the same words"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_A", F.lit("old")).withColumn("kept", F.lit(1))
    got = alignment.with_pair_counts(alignment.align_tokens(df), pieces.codec(pieces.default_model()).size)
    assert got.columns[:2] == ["doc_id", "kept"] and got.count() == len(rows)
    made = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got.collect()]
    assert sorted(made, key=repr) == sorted(brute(rows), key=repr)
    zero = {r.doc_id for r in got.collect() if not r.n_a}
    assert {0, 1, HARD.index("▁x▁")} <= zero and HARD.index("<|endoftext|> x") not in zero
    assert alignment.with_pair_counts(alignment.align_tokens(df.where("false")), 32_000).count() == 0


def test_groups_and_overlaps_of_intervals():
    a, b = np.array([0, 3, 5, 9]), np.array([0, 2, 5, 6, 9])
    first_a, first_b = alignment.groups_of(a[:-1], a[1:], b[:-1], b[1:])
    assert (first_a.tolist(), first_b.tolist()) == ([0, 2, 3], [0, 2, 4])
    left, right, together = alignment.overlaps(a[:-1], a[1:], b[:-1], b[1:])
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)] and together.tolist() == [False, False, True, False, True]


@pytest.mark.parametrize("name", ["op12_token_alignment", "op13_piece_ids"])
def test_queries_over_the_documents(spark, library, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES[name](spark, FOLDER).collect()
    assert len(got) == len(rows)
    if name == "op12_token_alignment":
        made = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got]
        assert sorted(made, key=repr) == sorted(brute(rows), key=repr)
        return
    texts = dict(rows)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *digests]
