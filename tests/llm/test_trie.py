"""The prefix trie against one that is built turn by turn, and the parentheses against a plain stack."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tablemill.llm import trie
from tablemill.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences_of(rows, every=100, heads=6):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in turns.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = own.get(c - (c % every if c >= 0 else -(-c % every)), [])
        made[c] = base[:h] + ts[h:]
    return made


def brute(made):
    members, ends = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def totals(node):
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below = [totals(k) for k in children.get(node, [])]
        return (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))

    out = []
    for node, ids in members.items():
        leaves, saved = totals(node)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])), leaves, saved, digest))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = trie.prefix_trie(trie.rebuilt(trie.turn_digests(df)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def conversation(c, n, rng, words):
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for t in range(n)]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_trie_equals_one_built_turn_by_turn(spark, monkeypatch, seed, small):
    if small:  # many shards, so that spines are shared
        monkeypatch.setattr(trie, "SHARD_NODES", 5)
    rng = random.Random(seed)
    ids = [0, 100, 200] + rng.sample(range(-250, 320), 60) + [10**13 + 7, 10**13]
    rows = [r for c in dict.fromkeys(ids) for r in conversation(c, rng.randint(1, 7), rng, ["", "a", "bc", "é\U0001f600x"])]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(sequences_of(rows))


def test_odd_rows_and_copies(spark):
    """Nulls everywhere, repeated rows, equal turn numbers, ids without rows for their base, conversations that only copy."""
    rows = [(None, 1, "user", "lost"), (None, None, None, None), (7, None, None, None), (7, 1, "u", "x"), (7, 1, "u", "x"), (107, 3, None, "y"),
            (300, 1, "u", "hello"), (300, 2, None, None)] + [(300 + i, 1, "u", "z") for i in range(1, 60)]
    assert found(spark, rows) == brute(sequences_of(rows))


def test_a_long_conversation_with_many_that_leave_it(spark):
    """One conversation holds most turns; two copies of its opening leave it at every fifth place."""
    rows = [(100_000, t, "u", f"t{t}") for t in range(600)]
    digests = trie.turn_digests(spark.createDataFrame(rows, SCHEMA)).collect()
    first = [(r.d1, r.d2, r.chars) for r in sorted(digests, key=lambda r: r.no)]
    assert len(first) == 600
    sequences = {100_000: first} | {i: first[: 5 * i] + ([(i, i, 3)] if i % 2 else []) for i in range(1, 40)} | {1000 + i: first[: 5 * i] for i in range(1, 40)}
    flat = [(c, 0, 0, 0, 0, len(s)) for c, s in sequences.items()] + [(c, d + 1, *x, len(s)) for c, s in sequences.items() for d, x in enumerate(s)]
    got = trie.prefix_trie(spark.createDataFrame(flat, "conv_id long, depth long, d1 long, d2 long, chars long, length long"))
    expected = brute({c: [((a, b), "x" * n) for a, b, n in s] for c, s in sequences.items()})
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []
    extra = spark.createDataFrame([(5, 1, "u", "hi", 9, 9)], SCHEMA + ", depth long, n1 long")
    assert trie.prefix_trie(trie.rebuilt(trie.turn_digests(extra))).count() == len(brute(sequences_of([(5, 1, "u", "hi")])))


@pytest.mark.parametrize("shape", ["deep", "wide", "random"])
def test_parentheses(shape):
    rng = random.Random(7)
    n = 3000
    level = list(range(n)) if shape == "deep" else [0] + [1] * (n - 1) if shape == "wide" else [0]
    while len(level) < n:
        level.append(rng.randint(1, min(level[-1] + 1, 40)))
    bits, stack, expected, opens = [], [], {}, []
    for i, depth in enumerate(level):
        while len(stack) > depth:
            expected[stack.pop()] = len(bits)
            bits.append(False)
        stack.append(len(bits))
        opens.append(len(bits))
        bits.append(True)
    while stack:
        expected[stack.pop()] = len(bits)
        bits.append(False)
    got = trie.ExcessBlocks(np.array(bits)).find_close(np.array(opens))
    assert got.tolist() == [expected[o] for o in opens]


def test_query_over_the_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_prefix_trie"](spark, folder).collect()), key=repr)
    assert got == brute(sequences_of(rows))
