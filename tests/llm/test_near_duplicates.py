"""Links and components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablemill.llm import minhash
from tablemill.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(lowest.get(find(i), d), d)
    return Counter((d, len(s), (lowest.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, ids = [], iter(range(10_000))
    for size in (1, 2, 3, 4, 30, 120, 400):
        base = [rng.choice(words) for _ in range(size)]
        for change in (0, 0, 0, 0.01, 0.02, 0.03, 0.05, 0.08):
            rows.append((next(ids), " ".join(rng.choice(words) if rng.random() < change else w for w in base)))
    hub = [rng.choice(words) for _ in range(150)]
    for _ in range(60):  # a large group whose members are near its middle but not near each other
        changed = hub[:]
        for i in rng.sample(range(150), rng.randint(0, 9)):
            changed[i] = rng.choice(words)
        rows.append((next(ids), " ".join(changed)))
    rows += [(next(ids), None), (next(ids), ""), (next(ids), " \t\n"), (next(ids), "Upper CASE É x"), (next(ids), "upper case É X"), (next(ids), "upper case é x")]
    rows += [rows[0], rows[-1], (None, "only a null id here"), (None, rows[20][1]), (next(ids), "long " * 20_000), (next(ids), "long " * 20_000)]
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, k, percent):
    rows = corpus()
    df = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, kept string, component_id int")
    got = minhash.near_duplicates(df.repartition(5), shingle=k, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, percent)
    for r in got:
        assert r.kept == (r.component_id is None if r.doc_id is None else r.doc_id == r.component_id)


def test_large_buckets_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rows = corpus(seed=8)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_documents(spark):
    from tablemill.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op2_near_duplicates"](spark, FOLDER).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)


def test_signature_values_are_minima_and_maxima():
    """The share of equal values estimates the similarity from both ends."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3_000).astype(np.uint64)
    a, b = pool[:2_000], pool[500:]
    seeds = minhash._mixed(np.arange(1, 401, dtype=np.uint64) * np.uint64(minhash.ODD[0]))
    factor, shift = (seeds[:200] | np.uint64(1))[:, None], seeds[200:][:, None]
    ends = [((factor * s + shift).min(1), (factor * s + shift).max(1)) for s in (a, b)]
    for low in (0, 1):
        assert abs(float((ends[0][low] == ends[1][low]).mean()) - 1_500 / 3_000) < 0.12


def test_bands_rule():
    for similarity in (0.8, 0.85):
        b = minhash.bands_for(similarity)
        assert (1 - similarity**5) ** b <= 1e-8 < (1 - similarity**5) ** (b - 1)


def test_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}}
