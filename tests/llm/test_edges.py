"""Cases at the edges of the operators' ranges."""

import pytest

from tablemill.llm import ann, chunks, warc
from tablemill.llm.decontamination import Index, Statistics, find_leaks, item_shingles


@pytest.mark.parametrize("low", [-(2**63), -5 * 10**15, 10**13, 2**63 - 3])
def test_archives_of_any_page_id(spark, low):
    rows = [(low, "http://a.example/x", "p" * 200), (low + 1, "http://a.example/y", "p" * 200), (low + 2, None, None)]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[low + i].record_type for i in range(3)] == ["response", "revisit", "response"]
    assert got[low + 1].refers_to == low and got[low + 2].payload_bytes == 0


def test_vectors_beyond_the_range_of_squares(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [3.0, 4.0]), (3, [5e-324, 0.0]), (4, [0.0, -1.7e308])]
    usable = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(usable, ann.build_index(usable), k=4).collect()}
    half = 0.5**0.5
    expected = {(0, 1): half, (0, 2): 0.6, (0, 3): 1.0, (0, 4): 0.0, (1, 2): 1.4 * half, (1, 4): -half, (2, 4): -0.8, (3, 4): 0.0}
    for pair, score in expected.items():
        assert got[pair] == pytest.approx(score, abs=1e-12) and got[pair[::-1]] == pytest.approx(score, abs=1e-12)


def test_short_items_are_searched(spark):
    items = [(1, "Capital of France? Paris"), (2, "Two words"), (3, "Who wrote the old book? Anna"), (4, "?!"), (5, None)]
    texts = [(1, "They asked: capital of France? Paris, of course."), (2, "paris is the capital of france"), (3, "there are two words here"),
             (4, "who wrote the old book anna said"), (5, "words two"), (6, None), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [3], 5: [], 6: [], 7: []}
    assert item_shingles(["a", "b"], ["c"]) == (3, {("a", "b", "c")}, {("a", "b", "c")})


def test_scores_do_not_depend_on_the_number_of_shards():
    items = [(i, f"What is the name of place number {i} in the county of w{i % 7} and x{i}? It is y{i} by the river z{i % 3}") for i in range(40)]
    statistics = Statistics()
    for _, text in items:
        statistics.add(text)
    whole = {leak["item_id"]: leak["score"] for _, text in items for leak in Index(items).leaks(text)}
    parted = {leak["item_id"]: leak["score"] for part in (items[:13], items[13:]) for _, text in part for leak in Index(part, statistics).leaks(text)}
    assert whole.keys() == parted.keys() == set(range(40)) and all(parted[i] == pytest.approx(whole[i]) for i in whole)


def test_rows_that_repeat_and_texts_shorter_than_a_run(spark):
    """One row repeated a thousand times gives its windows once; a text too short for a run of its own holds windows for others."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    long, short = " ".join(words[:60]), " ".join(words[100:113])
    assert chunks.WINDOW < len(short) < chunks.RUN
    other = f"{' '.join(words[200:240])} {short} {' '.join(words[240:280])}"
    rows = [(1, long)] * 1000 + [(None, long)] * 500 + [(3, short), (4, other), (5, f"{long} {' '.join(words[300:330])}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = chunks.repeated_runs(df).collect()
    assert len(held) == len({r.key for r in held}) and all(len(r.shared) <= 3 for r in held)
    got = chunks.mark_repeats(df)
    assert got.count() == len(rows)
    five = got.where("doc_id = 5").head()
    assert five.repeated_spans and five.repeated_spans[0].end - five.repeated_spans[0].start > 0.8 * len(long)
    assert got.where("doc_id = 1 and size(repeated_spans) > 0").isEmpty() and got.where("doc_id is null and size(repeated_spans) = 0").isEmpty()
    chunk_rows = chunks.windows(chunks.cut_points(__import__("numpy").frombuffer(short.encode(), "uint8")))
    assert chunk_rows
