"""Near-duplicates by min-max hashing.

Each permutation gives two signature values, the minimum and the maximum over a document's shingles, so a signature of K values
takes K/2 hash evaluations a shingle. Values are banded; documents that share a band are candidates, and candidates are
confirmed on their full shingle sets.

Groups of any size are linked without listing their pairs: equal sets are one class; the classes in a band's bucket are
compared with the one that shares most buckets; only where that leaves a bucket in several components are the classes outside its
largest component compared with the rest: pair by pair in small buckets, in blocks in large ones, whose tasks give back no more links
than join the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import staged
from tablemill.llm.components import connected_components

ROWS_PER_BAND = 5
MISS = 1e-8  # most that a pair at the threshold may miss all bands
SHINGLES_AT_ONCE = 4096
MEMO_WORDS = 200_000
SMALL_BUCKET = 16  # classes; larger buckets are compared in blocks
BLOCK = 128  # classes of a block
COLUMNS_AT_ONCE = 4_096
BLOCK_BITS, FILTER_BLOCKS = 32_768, 1_024  # bits of one of Spark's bitmaps; most blocks of a filter (4 MB)
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def bands_for(similarity: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands after which a pair of that similarity shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(ODD[0])
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(ODD[1])
    return x ^ (x >> np.uint64(32))


def _node(hashes: np.ndarray) -> int | None:
    """The 64-bit digest of a set; equal sets are one node of the link graph."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else None


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes. Words are runs of bytes other than ASCII white space, A-Z in lower case."""

    def __init__(self, words: int):
        import xxhash

        self.size, self.digest = words, xxhash.xxh3_64_intdigest
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.digest(w)
        codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(codes))
        count = len(codes) - size + 1
        out = np.full(count, len(words) if len(words) < self.size else 0, np.uint64)
        for k in range(size):
            out = _mixed(out * np.uint64(0x100000001B3) + codes[k : k + count])
        return np.unique(out)


def _signer(shingle: int, bands: int, rows: int):
    values = bands * rows
    half = (values + 1) // 2

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _mixed(np.arange(1, 2 * half + 1, dtype=np.uint64) * np.uint64(ODD[0]))
        factor, shift = (seeds[:half] | np.uint64(1))[:, None], seeds[half:][:, None]
        shingles = Shingler(shingle)
        for batch in batches:
            sizes, sets, keys = [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py())
                sizes.append(len(hashes))
                if not len(hashes):
                    sets.append(None)
                    keys.append(None)
                    continue
                low = np.full(half, np.iinfo(np.uint64).max, np.uint64)
                high = np.zeros(half, np.uint64)
                for start in range(0, len(hashes), SHINGLES_AT_ONCE):
                    permuted = factor * hashes[None, start : start + SHINGLES_AT_ONCE] + shift
                    np.minimum(low, permuted.min(axis=1), out=low)
                    np.maximum(high, permuted.max(axis=1), out=high)
                signature = np.concatenate([low, high])[:values].reshape(bands, rows)
                key = np.arange(bands, dtype=np.uint64)
                for column in signature.T:
                    key = _mixed(key * np.uint64(0x100000001B3) + column)
                sets.append(_node(hashes))
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "row", "n_shingles", "node", "bands"],
            )

    return sign


def _set_maker(shingle: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column(0)]
            nodes = [_node(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return make


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets meet the threshold; ``sets`` has a row for each class that is in a pair."""
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("right")), "v").join(
        sets.select(F.col("node").alias("u"), F.col("shingles").alias("left")), "u"
    )
    common = F.size(F.array_intersect("left", "right"))
    return both.where(100 * common >= percent * (F.size("left") + F.size("right") - common)).select("u", "v")


def _block_links(percent: int):
    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the rows of two blocks (or within one) that join components: a forest, never all pairs."""
        rows = rows.sort_values("node").drop_duplicates("node")
        nodes, parts = rows["node"].to_numpy(), rows["component"].to_numpy()
        sets = rows["shingles"].tolist()
        lengths = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), lengths)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[column] > 1
        owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for start in range(0, width, COLUMNS_AT_ONCE):
            lo, hi = np.searchsorted(column, (start, start + COLUMNS_AT_ONCE))
            held = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
            held[owner[lo:hi], column[lo:hi] - start] = 1
            common += held @ held.T
        whole = lengths[:, None] + lengths[None, :] - common
        a, b = np.nonzero(np.triu(100 * common.astype(np.int64) >= percent * whole.astype(np.int64), 1))
        root = {p: p for p in parts.tolist()}

        def find(p: int) -> int:
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            return p

        found = []
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(parts[i]), find(parts[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((nodes[i], nodes[j]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return link


def _linked_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join components inside large buckets. Blocks of one bucket's largest component do not meet each other."""
    outer = F.col("component") != F.col("top")
    counts = members.groupBy("bucket").agg(F.ceil(F.sum(outer.cast("int")) / BLOCK).alias("outer_blocks"), F.ceil(F.sum((~outer).cast("int")) / BLOCK).alias("inner_blocks"))
    dealt = members.join(counts, "bucket")
    own = F.when(outer, F.pmod(F.xxhash64("node"), "outer_blocks")).otherwise(F.col("outer_blocks") + F.pmod(F.xxhash64("node"), "inner_blocks"))
    last = F.when(outer, F.col("outer_blocks") + F.col("inner_blocks") - 1).otherwise(F.col("outer_blocks") - 1)
    meets = dealt.withColumn("own", own).select("bucket", "node", "component", "own", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    met = meets.select("bucket", "node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return met.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(_block_links(percent), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id).

    Two documents are linked when 100 * common shingles >= percent * all shingles of both. A text with fewer words than ``shingle``
    has its whole word sequence as one shingle. A null or wordless text has none, is linked with nothing, and is kept. Rows that
    repeat an id get a row each, by their own texts. A null id is never a component's id; such a row is kept only where its
    component has no other id. Other columns are not looked at. Shingles are compared as 64-bit hashes, and sets by a 64-bit digest.

    row: a long column that tells rows apart. It comes back as a fifth column, and kept is then true for one row of each component: of the
    rows with its smallest id (of all its rows, where none has an id) the one with the smallest row key. Rows equal in both are kept together.
    """
    bands = bands_for(percent / 100)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), (F.lit(None) if row is None else F.col(row)).cast("long").alias("row"))
    signed = staged(rows.mapInArrow(_signer(shingle, bands, ROWS_PER_BAND), "id long, row long, n_shingles long, node long, bands array<long>"))

    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("least")
    firsts = [F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *([] if row is None else [least])]
    classes = signed.where("node is not null").groupBy("node").agg(*firsts)
    classes = staged(classes)
    banded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(banded.join(buckets, "bucket"))

    # the class that meets most others is likeliest near the middle of its group
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    pivots = members.select("bucket", "node").join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("top"))
    stars = members.join(pivots.select("bucket", F.col("top.node").alias("u")), "bucket").where("node <> u")
    stars = stars.select("u", F.col("node").alias("v"), F.col("n").alias("n_v")).distinct()
    sizes = classes.select(F.col("node").alias("u"), F.col("n").alias("n_u"))
    stars = staged(stars.join(sizes, "u").where(_near(percent)).select("u", "v"))
    first = staged(_linked(stars, _sets(rows, classes, stars, shingle), percent))
    component = connected_components(first)

    placed = members.join(component, "node", "left").select("bucket", "size", "node", "n", F.coalesce("component", "node").alias("component"))
    shares = placed.groupBy("bucket", "component").agg(F.count("*").alias("share"))
    largest = shares.groupBy("bucket").agg(F.max(F.struct("share", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    parted = staged(placed.join(largest.select("bucket", F.col("top.component").alias("top")), "bucket"))
    small, large = parted.where(F.col("size") <= SMALL_BUCKET), parted.where(F.col("size") > SMALL_BUCKET)

    outside = small.where("component <> top").select("bucket", F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("component").alias("part"))
    inside = small.select(F.col("bucket").alias("at"), F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("component").alias("other"), "top")
    once = (F.col("other") == F.col("top")) | (F.col("u") < F.col("v"))
    pairs = outside.join(inside, (F.col("bucket") == F.col("at")) & (F.col("part") != F.col("other")) & once & _near(percent))
    rest = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest = staged(rest)
    more = _linked(rest, _sets(rows, classes, rest, shingle), percent)
    nodes = large.select(F.col("node").alias("u"), F.col("node").alias("v"))
    more = staged(more.unionByName(_linked_in_blocks(large, _sets(rows, classes, nodes, shingle), percent)))
    component = component if more.isEmpty() else connected_components(first.unionByName(more))

    own = [] if row is None else ["least"]
    placed = classes.select("node", "rep", *own).join(component, "node", "left").select("node", "rep", *own, F.coalesce("component", "node").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("rep").alias("component_id"), *[F.min(c).alias(c) for c in own])
    named = placed.drop(*own).join(lowest, "component").select("node", "component_id", *own)
    out = signed.select("id", "row", "n_shingles", "node").join(named, "node", "left")
    found = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    if row is not None:
        one = F.col("node").isNull() | (F.col("id").eqNullSafe(F.col("least.id")) & F.col("row").eqNullSafe(F.col("least.row")))
        return out.select(F.col("id").alias("doc_id"), "n_shingles", found.alias("component_id"), one.alias("kept"), F.col("row").alias(row))
    kept = F.when(F.col("node").isNull() | found.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == found, F.lit(False)))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", found.alias("component_id"), kept.alias("kept"))


def _near(percent: int):
    """Sets that differ more in size cannot meet the threshold."""
    return (100 * F.least("n_u", "n_v")) >= (percent * F.greatest("n_u", "n_v"))


def _sets(rows: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Full sets of the classes in ``pairs``, made anew from the text of each class's smallest id (a row without id: of all such rows).

    Texts are picked where they are by a bitmap of hashed ids, at most FILTER_BLOCKS blocks of 4 KB; what it lets through by
    accident is dropped by the exact join that follows. So sets are shuffled, and texts are not.
    """
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = staged(classes.select("node", "rep").join(nodes, "node"))
    blocks = min(FILTER_BLOCKS, 1 + wanted.count() * 16 // BLOCK_BITS)

    def at(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks * BLOCK_BITS)) + 1

    bitmap = wanted.groupBy(F.bitmap_bucket_number(at("rep")).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at("rep"))).alias("bits"))
    place = F.bitmap_bit_position(at("id"))
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(at("id")) == F.col("block"))
    texts = held.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).select("text")
    sets = texts.mapInArrow(_set_maker(shingle), "node long, shingles array<long>")
    return staged(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
