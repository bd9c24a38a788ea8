"""Prefix trie over conversations: which openings they share, and what storing each opening once would save.

A node is a distinct sequence of first turns; it is known by sums of hashes of (place, turn), so that a running sum names all nodes of
a conversation. Nodes that the same conversations pass through form a chain; only its bottom matters for the shape of the trie. The
bottoms on a conversation's path number less than the square root of twice all turns, since each of them needs a conversation of its
own that leaves there, so that a path is a short row however long the conversation. Paths are sorted over ranges. A task cuts its range
into shards of bounded size and writes each shard's trie as balanced parentheses: findclose over blocks with minima of the excess gives
the end of a subtree, the rank of leaf pairs its leaves, cumulative sums its savings. Nodes at the seams, the shared spines, occur in
several shards; their parts are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import staged, union_all
from tablemill.operators.ordered import running

BLOCK = 64  # parentheses per block of the excess
SHARD_NODES = 50_000  # path entries in a shard
IDS_PER_CHUNK_BITS = 16  # ids that differ in these low bits alone are listed together
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_PARTS = 4  # hashes of 31 bits: their sums stay below 2^63 for 2^32 turns


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, d1, d2, chars) of each turn: its number in the conversation from 1, 120 bits of digest of role and text, code points.

    Turns go by ``turn``, null first; equal numbers go by digest. A null role or text is empty. Rows without conv_id belong to no
    conversation. A repeated row is a turn of its own.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        *[F.conv(F.substring(digest, start, 15), 16, 10).cast("long").alias(name) for name, start in (("d1", 1), ("d2", 16))],
        F.length(text).cast("long").alias("chars"),
    )
    return staged(running(rows, group_by=["conv_id"], order_by=["turn"], numbers=["no"]).drop("turn"))


def rebuilt(digests: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Sequences (conv_id, depth, d1, d2, chars, length) of rebuilt conversations, each with a row of depth 0.

    Conversation c begins with the first h turns (h = crc32(c) % heads) of conversation c - c % every, with what there is of them,
    and goes on with its own turns after its first h.
    """
    own = F.col("conv_id")
    taken = (F.crc32(own.cast("string")) % heads).alias("h")
    opening = F.sort_array(F.collect_list(F.struct("no", "d1", "d2", "chars")))
    openings = digests.where((own % every == 0) & (F.col("no") < heads)).groupBy(own.alias("base")).agg(opening.alias("opening"))
    convs = digests.groupBy("conv_id").agg(F.max("no").alias("turns")).select(own, "turns", taken, (own - own % every).alias("base"))
    joined = convs.join(openings, "base", "left").withColumn("head", F.expr("slice(coalesce(opening, array()), 1, cast(h as int))"))
    length = F.size("head") + F.greatest(F.lit(0).cast("long"), F.col("turns") - F.col("h"))
    convs = staged(joined.select("conv_id", "h", "head", F.size("head").cast("long").alias("b"), length.alias("length")))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", "d1", "d2", "chars")]
    first = convs.select("conv_id", "length", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.no").alias("depth"), F.col("t.d1").alias("d1"), F.col("t.d2").alias("d2"), F.col("t.chars").alias("chars"), "length")
    rest = digests.where(F.col("no") > F.crc32(own.cast("string")) % heads).join(convs.drop("head"), "conv_id")
    rest = rest.select("conv_id", (F.col("b") + F.col("no") - F.col("h")).alias("depth"), "d1", "d2", "chars", "length")
    return union_all([convs.select("conv_id", *nothing, "length"), first, rest])


def _name(values: list[Column], prefix: str) -> list[Column]:
    """Two long columns that name a node, from the sums of its hashes."""
    return [F.xxhash64(F.lit(1), *values).alias(f"{prefix}1"), F.xxhash64(F.lit(2), *reversed(values)).alias(f"{prefix}2")]


def _paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, upto, is_end, n1, n2, p1, p2): each node on each conversation's path, and its parent."""
    step = [
        F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "d1", "d2").bitwiseAND(F.lit((1 << 31) - 1))).otherwise(F.lit(0).cast("long"))
        for i in range(_PARTS)
    ]
    rows = sequences.select("conv_id", "depth", "chars", (F.col("depth") == F.col("length")).alias("is_end"), *[s.alias(f"e{i}") for i, s in enumerate(step)])
    sums = {f"s{i}": F.col(f"e{i}") for i in range(_PARTS)} | {"upto": F.col("chars")}
    summed = running(rows, group_by=["conv_id"], order_by=["depth"], sums=sums)
    here, before = [F.col(f"s{i}") for i in range(_PARTS)], [F.col(f"s{i}") - F.col(f"e{i}") for i in range(_PARTS)]
    return staged(summed.select("conv_id", "depth", "chars", "upto", "is_end", *_name(here, "n"), *_name(before, "p")))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, depth, d1, d2, chars, length), which has a row of depth 0 for each
    conversation: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Without conversations there is no node, not even the root.
    """
    paths = _paths(sequences)
    one = ("depth", "chars", "upto", "p1", "p2")  # the same for all members
    nodes = staged(paths.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in one]))
    below = nodes.where("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2"))
    children = staged(below.agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("alone")))
    chains = staged(_chains(nodes, children))
    totals = _subtrees(paths, chains).groupBy("n1", "n2").agg(F.sum("leaves").alias("leaves"), F.sum("saving").alias("saving"))
    # what lies under a chain, for each of its nodes
    known = chains.drop("leaves").join(totals, ["n1", "n2"]).select(
        F.col("conv_id").alias("c"), F.col("n").alias("m"), "leaves", (F.col("saving") - F.col("own")).alias("under"), F.col("upto").alias("bottom"))
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    single = F.col("n") == 1
    saved = F.col("under") + (F.col("n") - 1) * (F.col("bottom") - F.col("upto") + F.col("chars"))
    in_chain = (F.col("conv_id") == F.col("c")) & (F.col("n") == F.col("m")) & ~single
    full = nodes.join(children, ["n1", "n2"], "left").join(_ends(paths), ["n1", "n2"], "left").join(parents, ["p1", "p2"], "left").join(known, in_chain, "left")
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(single, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(single, F.lit(0)).otherwise(saved).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def _chains(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """One row per chain of shared nodes with the same members, which the smallest member and their number tell apart: its bottom node
    (n1, n2, depth, upto), leaves that hang from the bottom itself, and ``own``, the saving of the whole chain."""
    shared = nodes.where("n > 1").join(children, ["n1", "n2"], "left")
    bottom = F.max_by(F.struct("n1", "n2", "depth", "upto", "n_children", "alone"), "depth").alias("b")
    chains = shared.groupBy("conv_id", "n").agg(bottom, F.min(F.col("upto") - F.col("chars")).alias("before"))
    return chains.select(
        "conv_id", "n", "b.n1", "b.n2", "b.depth", "b.upto", F.coalesce("b.alone", F.lit(1)).alias("leaves"),
        ((F.col("n") - 1) * (F.col("b.upto") - F.col("before"))).alias("own"))


def _subtrees(paths: DataFrame, chains: DataFrame) -> DataFrame:
    """(n1, n2, leaves, saving) of chain bottoms, in parts that add up over the shards."""
    bottoms = chains.select("n1", "n2", F.col("conv_id").alias("first"), "leaves", "own")
    walked = paths.join(chains.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "depth", "n1", "n2")
    mine = F.col("conv_id") == F.col("first")  # a bottom's own figures go with one path alone
    entry = F.struct("depth", "n1", "n2", *[F.when(mine, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("leaves", "own")])
    lists = walked.join(bottoms, ["n1", "n2"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("path"))
    keyed = lists.select("path", F.transform("path", lambda e: F.struct(e["n1"].alias("n1"), e["n2"].alias("n2"))).alias("key"))
    fields = ("n1", "n2", "leaves", "own")
    dealt = keyed.repartitionByRange("key").sortWithinPartitions("key")
    flat = dealt.select(*[F.col(f"path.{f}").alias(f) for f in fields])
    return flat.mapInArrow(_shards, "n1 long, n2 long, leaves long, saving long")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes: list[list[int]] = []  # level, n1, n2, leaves, own: the shard's trie in preorder
    spine: list[int] = []  # places of the current path's nodes
    for batch in batches:
        for n1, n2, leaves, own in zip(*[batch.column(f).to_pylist() for f in ("n1", "n2", "leaves", "own")]):
            if len(nodes) > SHARD_NODES:
                yield shard_totals(nodes)
                nodes, spine = [], []
            shared = 0
            while shared < min(len(spine), len(n1)) and nodes[spine[shared]][1:3] == [n1[shared], n2[shared]]:
                node = nodes[spine[shared]]
                node[3] += leaves[shared]
                node[4] += own[shared]
                shared += 1
            del spine[shared:]
            for level in range(shared, len(n1)):
                spine.append(len(nodes))
                nodes.append([level, n1[level], n2[level], leaves[level], own[level]])
    if nodes:
        yield shard_totals(nodes)


def shard_totals(nodes: list[list[int]]) -> pa.RecordBatch:
    """Leaves and savings of every subtree of a shard, whose nodes are given in preorder."""
    level, n1, n2, leaves, own = (np.array(c, dtype=np.int64) for c in zip(*nodes))
    # a node is an open parenthesis; the leaves that hang from it are one pair inside it, which counts as many times
    closes = np.concatenate([[0], level[:-1] - level[1:] + 1])
    inner = (leaves > 0).astype(np.int64)
    width = closes + 1 + 2 * inner
    opens = np.cumsum(width) - width + closes
    total = int(width.sum() + level[-1] + 1)
    bits = np.zeros(total, dtype=bool)
    bits[opens] = True
    bits[opens[inner == 1] + 1] = True
    closing = ExcessBlocks(bits).find_close(opens)

    pair = np.flatnonzero(bits[:-1] & ~bits[1:])
    times = np.zeros(total, dtype=np.int64)
    times[opens[inner == 1] + 1] = leaves[inner == 1]
    counted = np.concatenate([[0], np.cumsum(times[pair])])
    n_leaves = counted[np.searchsorted(pair, closing)] - counted[np.searchsorted(pair, opens)]
    gained = np.zeros(total, dtype=np.int64)
    gained[opens] = own
    sums = np.concatenate([[0], np.cumsum(gained)])
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in (n1, n2, n_leaves, sums[closing] - sums[opens])], names=["n1", "n2", "leaves", "saving"])


class ExcessBlocks:
    """Excess of opening over closing parentheses, with its minimum per block and a tree of minima over the blocks."""

    def __init__(self, bits: np.ndarray):
        excess = np.cumsum(np.where(bits, 1, -1))
        self.excess = excess
        blocks = -(-len(bits) // BLOCK)
        beyond = np.iinfo(np.int64).max
        self.rows = np.full((blocks, BLOCK), beyond, dtype=np.int64)
        self.rows.reshape(-1)[: len(bits)] = excess
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        self.lowest = np.full(2 * self.leaves, beyond, dtype=np.int64)
        self.lowest[self.leaves : self.leaves + blocks] = self.rows.min(axis=1)
        for at in range(self.leaves - 1, 0, -1):
            self.lowest[at] = min(self.lowest[2 * at], self.lowest[2 * at + 1])

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The place of the closing parenthesis of each opening one: the first place after it with an excess one lower."""
        target = self.excess[opens] - 1
        block, offset = opens // BLOCK, opens % BLOCK
        close = self._first(block, offset + 1, target)
        far = np.flatnonzero(close < 0)
        if len(far):
            goal, node = target[far], block[far] + self.leaves
            searching = np.ones(len(far), dtype=bool)
            while searching.any():  # up, until the right neighbour goes low enough
                right = searching & (node % 2 == 0)
                hit = right.copy()
                hit[right] = self.lowest[node[right] + 1] <= goal[right]
                node[hit] += 1
                searching &= ~hit
                node[searching] //= 2
            while (above := node < self.leaves).any():  # down, to the first block that goes low enough
                left = 2 * node[above]
                node[above] = np.where(self.lowest[left] <= goal[above], left, left + 1)
            close[far] = self._first(node - self.leaves, np.zeros(len(far), dtype=np.int64), goal)
        return close

    def _first(self, block: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place of a block, from an offset on, with an excess of at most the target, or -1."""
        found = np.full(len(block), -1, dtype=np.int64)
        place = np.arange(BLOCK)
        for low in range(0, len(block), 8192):
            part = slice(low, low + 8192)
            fits = (self.rows[block[part]] <= target[part, None]) & (place >= start[part, None])
            found[part] = np.where(fits.any(axis=1), block[part] * BLOCK + fits.argmax(axis=1), -1)
        return found


def _ends(paths: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): digest of the ascending ids of conversations that end at a node. Ids are listed in chunks of bounded size,
    which one task per node reads in order without keeping them."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    chunk = F.shiftright("conv_id", IDS_PER_CHUNK_BITS).alias("chunk")
    chunks = paths.where("is_end").groupBy("n1", "n2", chunk).agg(ids)
    ordered = chunks.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "chunk").select("n1", "n2", "ids")
    return ordered.mapInArrow(_hashed, "n1 long, n2 long, ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, hashlib.sha256()

    def batch(rows):
        columns = [pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["n1", "n2", "ends_sha256"])

    for chunks in batches:
        done = []
        for n1, n2, ids in zip(*[c.to_pylist() for c in chunks.columns]):
            if (n1, n2) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = (n1, n2), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield batch(done)
    if node is not None:
        yield batch([(node, state.hexdigest())])
