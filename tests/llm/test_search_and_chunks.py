"""Nearest neighbours, benchmark leaks and repeated passages against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import ann, chunks, decontamination

FOLDER = "/root/testdata/sf0.001"


def brute_nearest(rows, k):
    """rows: distinct (id, vector) pairs."""
    out = set()
    for q, v in rows:
        if q % 50:
            continue
        scored = sorted((-float(np.dot(v, w)) / (np.linalg.norm(v) * np.linalg.norm(w)), c) for c, w in rows if c != q and len(w) == len(v))
        out |= {(q, i + 1, c) for i, (_, c) in enumerate(scored[:k])}
    return out


def test_recall_on_the_embeddings(spark):
    from tablemill.llm.queries import QUERIES

    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = QUERIES["op6_nearest_neighbours"](spark, FOLDER).collect()
    want = {(q, c) for q, _, c in brute_nearest(rows, 5)}
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    vectors = dict(rows)
    for r in got:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_recall_with_clusters_copies_and_many_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 24))
    vectors = [centres[i % 8] + 0.05 * rng.normal(size=24) for i in range(1_500)]
    vectors += [vectors[0]] * 200 + [2 * vectors[1]] * 3 + list(rng.normal(size=(40, 24)) * 50)
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    usable = ann.usable(df)
    got = ann.nearest(usable.where("id % 50 = 0"), ann.build_index(usable, rows_per_shard=300), 5).collect()
    want = {(q, c) for q, _, c in brute_nearest(rows, 5)}
    scores = {(r.query_id, r.rank): r.score for r in got}
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    assert all(scores[(q, k)] >= scores[(q, k + 1)] for q, k in scores if (q, k + 1) in scores)
    copies = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1500]
    assert copies == [0, 1501, 1502, 1503, 1504]  # ties to the smaller id


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []),
            (7, [1.0, 0.1]), (7, [1.0, 0.1]), (None, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    usable = ann.usable(df)
    got = ann.nearest(usable.where("id % 50 = 0"), ann.build_index(usable), 5).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 7), (0, 2, 8)]
    none = ann.usable(df.where("vec_id = 1"))
    assert ann.nearest(none, ann.build_index(none), 5).count() == 0


def contained(docs, items):
    """(doc, item) pairs in which nearly all five-word shingles of the item occur."""
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 4)}
    sets = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for g in [grams(t)] for i, s in sets.items() if s and len(s & g) >= 0.99 * len(s)}


def test_leaks_match_brute_force(spark):
    from tablemill.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = QUERIES["op8_benchmark_leaks"](spark, FOLDER).collect()
    assert {(r.doc_id, r.item_id) for r in got} == contained(docs, items)


def leaks_by_hand(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, LEAKS string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return Counter((r.doc_id, leak.item_id) for r in decontamination.find_leaks(d, b, **options).collect() for leak in r.leaks)


def test_planted_leaks(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(n)) + "? " + " ".join(word() for _ in range(4)) + ".") for i, n in enumerate([8, 20, 30, 70, 150])]
    filler = [" ".join(word() for _ in range(400)) for _ in range(6)]
    docs = [(i, filler[i % 6][:900] + " " + t.upper() + " " + filler[(i + 1) % 6]) for i, t in items]
    docs += [(100, items[2][1].split("?")[0]), (101, items[2][1].split("?")[1]), (102, filler[0]), (103, None), (104, ""), (None, items[1][1]), (1, docs[1][1])]
    docs += [(105, "x " * 40_000 + items[3][1]), (106, items[0][1] + " " + items[4][1])]
    odd = [(90, None), (91, ""), (92, "too short"), (None, items[1][1])]
    want = Counter({(0, 0): 1, (1, 1): 2, (2, 2): 1, (3, 3): 1, (4, 4): 1, (None, 1): 1, (105, 3): 1, (106, 0): 1, (106, 4): 1, (1, None): 2, (None, None): 1})
    assert leaks_by_hand(spark, docs, items + odd) == want  # question or answer alone is no leak
    monkeypatch.setattr(decontamination, "ITEMS_PER_SHARD", 2)
    assert leaks_by_hand(spark, docs, items + odd) == want
    assert leaks_by_hand(spark, docs, []) == Counter() and leaks_by_hand(spark, [], items) == Counter()


def test_block_maxima_never_hide_a_part():
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40)))) for i in range(50)]
    index = decontamination.Index(items)
    words = [rng.choice(vocabulary) for _ in range(300)]
    got = {}
    for passage, item, score in index.retrieve(words, 0.3):
        got[(passage, item)] = max(got.get((passage, item), 0), score)
    want = {}
    for passage in range(0, 300 // decontamination.PART_WORDS + 1):
        window = set(words[passage * decontamination.PART_WORDS : (passage + 2) * decontamination.PART_WORDS])
        terms = np.array(sorted(index.terms[t] for t in window if t in index.terms), int)
        for block in range(len(index.blocks)):
            for part, score in enumerate(index.scored(terms, block)):
                if score >= 0.3:
                    item = index.item_of[block * decontamination.BLOCK + part]
                    want[(passage, item)] = max(want.get((passage, item), 0), score)
    assert got and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_passages_of_fifty_words_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeéöü") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(52, 90))) for _ in range(25)]
    docs = []
    for i in range(75):
        around = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(2)]
        docs.append((i, f"{around[0]} {passages[i % 25]} {around[1]}", "x"))
    docs += [(200, " ".join(word() for _ in range(300)), "x"), (201, None, "x"), (202, "", "x"), (None, docs[0][1], "x"), (0, docs[0][1], "x"), (203, "ab " * 40_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shared_spans string")
    got = chunks.mark_repeats(df)
    rows = got.collect()
    assert len(rows) == len(docs)
    found = 0
    for r in rows:
        if r.doc_id in (200, 201, 202):
            assert r.shared_spans == [] and r.repeated_spans == []
        elif r.doc_id is not None and r.doc_id < 75:
            start = r.text.index(passages[r.doc_id % 25])
            stop = start + len(passages[r.doc_id % 25])
            covered = sum(max(0, min(s.end, stop) - max(s.start, start)) for s in r.shared_spans)
            found += covered >= 0.5 * (stop - start)
            assert r.doc_id == 0 or all(start - 8 <= s.start and s.end <= stop + 8 for s in r.shared_spans)  # a few characters may agree by chance
            assert (r.repeated_spans == []) == (r.doc_id < 25)
    assert found >= 74
    null_id = next(r for r in rows if r.doc_id is None)
    assert sum(s.end - s.start for s in null_id.repeated_spans) > 0.9 * len(null_id.text)
    kept = got.select("text", "repeated_spans", chunks.without_repeats(F.col("text"), F.col("repeated_spans")).alias("kept")).collect()
    for r in kept:
        text = r.text
        for s in reversed(r.repeated_spans):
            text = text[: s.start] + text[s.end :]
        assert r.kept == text
    assert chunks.mark_repeats(df.where("false")).count() == 0


def test_cuts_come_back_in_step_after_an_insertion():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 5_000).astype(np.uint8)
    shifted = np.concatenate([data[:1_000], np.frombuffer(b"inserted", np.uint8), data[1_000:]])
    before, after = set(chunks.cut_points(data)), {c - 8 for c in chunks.cut_points(shifted) if c > 1_400}
    assert after == {c for c in before if c > 1_392}
    assert all(b - a <= chunks.LARGEST for a, b in zip([0, *sorted(before)], sorted(before)))


def test_query_over_the_documents_marks_what_is_elsewhere(spark):
    from tablemill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    whole = "\x00".join(texts.values())
    got = QUERIES["op4_repeated_passages"](spark, FOLDER).collect()
    assert len(got) == len(texts) and any(r.repeated_chars for r in got)
    for r in got:
        for span in filter(None, r.shared_spans.split(",")):
            a, b = map(int, span.split(":"))
            piece = texts[r.doc_id][a : a + 20]
            assert b - a >= chunks.RUN and whole.index(piece) != whole.rindex(piece)


@pytest.mark.parametrize("text", ["Is it so? Yes it is.", "Question one\nAnswer: two", "First part. Second part", "no marks at all here"])
def test_items_split_into_question_and_answer(text):
    question, answer = decontamination.question_and_answer(text)
    assert question and answer and question + answer == decontamination.words_of(text)


def test_chunks_from_several_places_are_no_repeat(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = " ".join(word() for _ in range(60))
    cuts = [0, *chunks.cut_points(np.frombuffer(text.encode(), np.uint8))]
    pieces = [(i, " ".join(word() for _ in range(30)) + " " + text[max(0, a - 16) : b] + " " + " ".join(word() for _ in range(30))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = [(i, t) for i, t in pieces if len(t) < 600] + [(9_000, text), (None, "first " + (lost := " ".join(word() for _ in range(80)))), (None, "second " + lost)]
    got = chunks.mark_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = next(r for r in got if r.doc_id == 9_000)
    assert whole.shared_spans == [] and whole.repeated_spans == []  # every chunk is somewhere else, no passage is
    without = [r for r in got if r.doc_id is None]
    assert all(r.shared_spans for r in without) and sum(bool(r.repeated_spans) for r in without) == 1
