"""Decoding and scoring; source schedules; the pipeline against its parts done by hand."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute as brute_components
from test_search_and_chunks import contained
from test_tokens_pii import plain_spans

import corpus_pipeline
from tablemill.llm import mixing, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder(spark):
    return toxicity.Decoder(toxicity.character_model(spark.read.parquet(f"{FOLDER}/documents.parquet")))


@pytest.mark.parametrize(
    ("hidden", "word"),
    [("$tup1d", "stupid"), ("cl0wn", "clown"), ("tr@sh", "trash"), ("scuuuuum", "scum"), ("m.o.r.o.n", "moron"), ("l-o-s-e-r", "loser"), ("p4th3tic", "pathetic"), ("the***", "the"), ("Clean", "clean")],
)
def test_hidden_words_are_restored(decoder, hidden, word):
    assert word in decoder.words(f"so {hidden} it")


def test_spaced_letters_make_a_word_too(decoder):
    assert "stupid" in decoder.words("you are s t u p i d indeed")


def test_viterbi_finds_the_best_path(decoder):
    """Against all paths through a small lattice without drops."""
    import itertools
    import math

    token, best = "1d0l", (-math.inf, "")
    for letters in itertools.product("il", "d", "o", "l"):
        word = "".join(letters)
        codes = [toxicity.EDGE, toxicity.EDGE, *[toxicity.CODE[c] for c in word], toxicity.EDGE]
        score = sum(decoder.model[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:])) + 2 * toxicity.SUBSTITUTE
        best = max(best, (score, word))
    assert decoder.restore(token) == best[1] or len(decoder.restore(token)) < 4  # a path that drops a sign may win


def test_held_out_rows_are_scored_well_and_not_learned_from(spark):
    from tablemill.llm.queries import QUERIES

    got = QUERIES["op3_toxicity"](spark, FOLDER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    ranks = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(ranks) / len(ranks) > 0.9
    assert sum(p >= 0.7 and not y for p, y in held) <= 0.03 * len(held)
    learned = toxicity.labelled_rows(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    assert learned and all(zlib.crc32(str(r.id).encode()) % 3 != 1 for r in learned)


def test_odd_rows_are_scored(spark):
    words = ["vile", "mean", "good", "fine", "blue", "tree"]
    rows = [(i, f"{words[i % 6]} {words[(i * 5 + i // 6) % 4 + 2]} text", "x") for i in range(240)]
    rows += [(None, None, "x"), (500, "", None), (500, "", None), (501, "v1le " * 30_000, "x"), (502, "v!ie vile viiile", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, int(i % 6 < 2)) for i in range(240)] + [(5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.labelled_rows(docs, labels))
    scored = toxicity.score_toxicity(docs, model)
    got = scored.collect()
    assert scored.columns == ["doc_id", "text", "score", "predicted"] and len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((round(r.score, 9), r.predicted))
    assert len(by[500]) == 1 and by[500] == by[None] and next(iter(by[501]))[1] == 1 and next(iter(by[502]))[1] == 1
    for one in (labels.where("false"), labels.where("toxic = 0")):
        untrained = toxicity.score_toxicity(docs, toxicity.train(docs, toxicity.labelled_rows(docs, one))).collect()
        assert all(r.predicted == 0 for r in untrained)
    empty = docs.where("false")
    assert toxicity.score_toxicity(empty, toxicity.train(empty, toxicity.labelled_rows(empty, labels))).count() == 0


def test_schedules_stay_within_a_block():
    rng = random.Random(1)
    for _ in range(20):
        weights = {f"s{i}": rng.random() ** 3 + 0.001 for i in range(rng.randint(1, 40))} | {None: 0.3}
        shares = mixing.whole_shares(weights, 4096)
        schedule = mixing.period_schedule(shares)
        assert sorted(x for v in schedule.values() for x in v) == list(range(4096)) and min(shares.values()) > 0
        for s, slots in schedule.items():
            rate = shares[s] / 4096
            assert all(abs(k - rate * x) < 1 and abs(k + 1 - rate * (x + 1)) < 1 for k, x in enumerate(slots))
        assert all(abs(shares[s] - 4096 * w / sum(weights.values())) < 2 for s, w in weights.items() if w > 0.05)


def test_mixed_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 70)
    rows = [(i, "big" if i % 3 else f"s{i % 7}", None) for i in range(900)] + [(None, None, None), (5000, None, None), (7, "big", None), (7, "big", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"big": 5, None: 1} | {f"s{i}": i + 1 for i in range(7)}
    got = mixing.mix(df, weights=weights, block=4).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, s, _ in rows)
    places = [(r.mix_slot, r.mix_offset) for r in got]
    assert len(set(places)) == len(places)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append((r.mix_slot, r.mix_offset, r.mix_block))
    shares = mixing.whole_shares(weights, mixing.PERIOD)
    for source, found in by_source.items():
        found.sort()
        assert [b for _, _, b in found] == [i // 4 for i in range(len(found))] and [o for _, o, _ in found] == [i % 4 for i in range(len(found))]
        slots = sorted({s for s, _, _ in found})
        assert all(abs(k - shares[source] / mixing.PERIOD * s) < 1 for k, s in enumerate(slots))
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"big": 1})
    assert mixing.mix(df.where("false")).count() == 0


def test_query_keeps_every_document(spark):
    from tablemill.llm.queries import QUERIES

    got = QUERIES["op7_source_mix"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got.select("doc_id", "source").exceptAll(docs.select("doc_id", "source")).isEmpty() and got.count() == docs.count()
    blocks = got.groupBy("source", "mix_block").agg(F.count("*").alias("n"), F.count_distinct("mix_slot").alias("slots")).collect()
    assert all(b.slots == 1 and b.n <= mixing.BLOCK for b in blocks)


def test_pipeline_against_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, toxicity.labelled_rows(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    decoder, weight = toxicity.Decoder(model.characters), dict(zip(model.names, model.weights))

    def score(text):
        found = toxicity.features(decoder.words(text))
        return 1 / (1 + np.exp(-(model.bias + sum(w * np.log1p(found[f]) for f, w in weight.items() if f in found))))

    left = {d: r.text for d, r in rows.items() if score(r.text) < corpus_pipeline.TOXIC}
    components = brute_components(list(left.items()), corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)
    left = {d: left[d] for d, _, c in components if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {d for d, _ in contained(left.items(), items)}
    left = {d: t for d, t in left.items() if d not in leaked}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == set(left) and len(got) == len(left) < len(rows)
    for r in got:
        text = left[r.doc_id]
        assert all(text[s:e] not in r.text or k == "card" for s, _, k, e in plain_spans(text)) and r.n_chars == len(r.text)
        if not plain_spans(text) and r.text != text:  # only terms that disclose an entity may have gone
            assert len(re.findall(r"\w+", r.text)) >= 0.8 * len(re.findall(r"\w+", text))
        assert (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source)
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == len(got)


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "some plain words here, nothing else", "en", "s", 35), (3, "mail a@b.co now please", None, "s", 22), (4, "word " * 20_000, "en", "t", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.where("false")):
        current = table
        for _, stage in corpus_pipeline.STAGES:
            before, current = current, stage(spark, current, str(tmp_path)).cache()
            assert current.columns[:5] == docs.columns and current.count() == before.count()


def test_one_row_of_each_group_of_near_copies_stays(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [
        (10, text(0)), (None, text(0)), (None, text(1)), (None, text(2)),  # a: documents without an id that have no copy stay
        (20, text(3)), (20, text(4)), (5, text(4) + " more"),  # b: an id on a unique text and on a near copy
        (30, text(5)), (30, text(5)), (30, text(5)), (None, text(6)), (None, text(6)), (None, text(6) + " more"),  # c: repeated rows, copies without ids
        (40, text(7)), (40, text(7) + " more"), (50, None), (50, None), (None, " "), (None, " "),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, (r.text or " ").split(" ")[0]) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(3), FOLDER).collect())
    want = [(10, "w0x0"), (None, "w1x0"), (None, "w2x0"), (20, "w3x0"), (5, "w4x0"), (30, "w5x0"), (None, "w6x0"), (40, "w7x0"), (50, ""), (50, ""), (None, ""), (None, "")]
    assert got == Counter(want)


@pytest.mark.parametrize(
    ("hidden", "word"),
    [("!diot", "idiot"), ("a$$", "ass"), ("bada$$", "badass"), ("@$$", "ass"), ("iddiioott", "idiot"), ("(unt", "cunt"), ("gone!", "gone"), ("well", "well"), ("the$$$", "the")]
    + [("s" * 50 + "tupid", "stupid"), ("s.t.u.p.i.d." * 6, "stupid" * 6), ("y o u a r e a m o r o n", "moron"), ("s t u p i d i d i o t", "idiot")],
)
def test_both_readings_of_ends_doubled_letters_and_long_tokens(decoder, hidden, word):
    assert word in decoder.words(f"so {hidden} then")


def test_a_doubled_letter_is_read_as_the_lattice_reads_it(decoder):
    for word in ("will", "iidiot", "idiiot", "idiott", "aa", "oof", "moroon", "ßßa", "loser", "trassh"):
        if m := toxicity.DOUBLED.search(word):
            assert decoder.halved(word, m.start()) == decoder.viterbi(word)


def test_sources_keep_to_exact_weights_over_many_periods(spark):
    df = spark.range(8_000).selectExpr("id AS doc_id", "concat('s', id % 20) AS source")
    weights = {f"s{i}": 1 + (i % 3) * 0.37 for i in range(20)}
    by_source = defaultdict(list)
    for r in mixing.mix(df, weights=weights, block=1, period=80).collect():
        by_source[r.source].append(r.mix_slot)
    assert len({x for slots in by_source.values() for x in slots}) == 8_000
    for source, slots in by_source.items():
        rate = weights[source] / sum(weights.values())
        assert all(abs(k - rate * x) < 1 and abs(k + 1 - rate * (x + 1)) < 1 for k, x in enumerate(sorted(slots)))
