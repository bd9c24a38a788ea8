"""Nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Vectors are dealt into shards of bounded size by a hash of their id. A shard's graph is built in one go: nodes get levels by chance,
every level links each node to diverse ones among its nearest, and links hold in both directions. Queries descend the levels of every
shard and widen at the lowest; the shards' results are merged by exact double-precision cosine.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import staged

ROWS_PER_SHARD = 16_384
QUERIES_PER_BLOCK = 4_096
LINKS = 16  # chosen neighbours of a node
CANDIDATES = 40  # nearest nodes that they are chosen from
WIDTH = 96  # nodes kept while searching the lowest level
INDEX = "dim int, shard long, size int, ids binary, starts binary, vectors binary, levels array<struct<nodes:binary,offsets:binary,links:binary>>"


def _links(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, links) of one level: of each node's nearest, those that are nearer to it than to one chosen before; then the nearest of the rest."""
    n = len(unit)
    wide = min(CANDIDATES, n - 1)
    if wide < 1:
        return np.zeros(n + 1, np.int32), np.empty(0, np.int32)
    sources, targets = [], []
    for start in range(0, n, 256):
        block = unit[start : start + 256]
        b = np.arange(len(block))
        near = block @ unit.T
        near[b, start + b] = -np.inf
        top = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
        to_node = np.take_along_axis(near, top, 1)
        among = np.matmul(unit[top], unit[top].transpose(0, 2, 1))
        chosen = np.zeros(top.shape, bool)
        for c in range(wide):
            covered = (chosen[:, :c] & (among[:, c, :c] >= to_node[:, c, None])).any(1)
            chosen[:, c] = ~covered & (chosen.sum(1) < LINKS)
        for c in range(wide):  # places left go to the nearest
            chosen[:, c] |= chosen.sum(1) < LINKS
        row, column = np.nonzero(chosen)
        sources.append(row + start)
        targets.append(top[row, column])
    u, v = np.concatenate(sources), np.concatenate(targets)
    both = np.unique(np.concatenate([u * n + v, v * n + u]))
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(both // n, minlength=n), out=offsets[1:])
    return offsets, (both % n).astype(np.int32)


class Graph:
    """One shard. Copies of a vector are one node; ``starts`` says where a node's ids begin in ``ids``."""

    def __init__(self, ids, starts, vectors, levels):
        self.ids, self.starts, self.vectors, self.levels = ids, starts, vectors, levels
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.unit = (vectors / self.norms[:, None]).astype(np.float32)
        self.seen = np.zeros(len(vectors), np.int64)
        self.turn = 0
        self.places = [dict(zip(nodes.tolist(), range(len(nodes)))) for nodes, _, _ in levels[1:]]

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, seed: int) -> Graph:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        first = np.ones(len(ids), bool)
        first[1:] = (vectors[1:] != vectors[:-1]).any(1)
        starts = np.append(np.flatnonzero(first), len(ids)).astype(np.int32)
        vectors = vectors[first]
        unit = (vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]).astype(np.float32)
        chance = np.random.default_rng(seed).random(len(vectors))
        height = np.floor(-np.log(1 - chance) / math.log(LINKS)).astype(int)
        levels = []
        for level in range(height.max() + 1):
            nodes = np.flatnonzero(height >= level).astype(np.int32)
            levels.append((nodes, *_links(unit[nodes])))
        return cls(ids, starts, vectors, levels)

    @classmethod
    def read(cls, row: pd.Series) -> Graph:
        as_ints = lambda b: np.frombuffer(b, np.int32)
        levels = [tuple(as_ints(level[k]) for k in ("nodes", "offsets", "links")) for level in row["levels"]]
        return cls(np.frombuffer(row["ids"], np.int64), as_ints(row["starts"]), np.frombuffer(row["vectors"]).reshape(-1, row["size"]), levels)

    def row(self) -> dict:
        levels = [{"nodes": a.tobytes(), "offsets": b.tobytes(), "links": c.tobytes()} for a, b, c in self.levels]
        return {"size": self.vectors.shape[1], "ids": self.ids.tobytes(), "starts": self.starts.tobytes(), "vectors": self.vectors.tobytes(), "levels": levels}

    def nearest_nodes(self, unit: np.ndarray) -> np.ndarray:
        """WIDTH nodes near a direction."""
        at = int(self.levels[-1][0][0])
        best = float(self.unit[at] @ unit)
        for level in range(len(self.levels) - 1, 0, -1):  # downhill on the upper levels
            nodes, offsets, links = self.levels[level]
            place, moved = self.places[level - 1], True
            while moved:
                i = place[at]
                around = nodes[links[offsets[i] : offsets[i + 1]]]
                moved = False
                if len(around):
                    near = self.unit[around] @ unit
                    j = int(near.argmax())
                    if near[j] > best:
                        at, best, moved = int(around[j]), float(near[j]), True
        _, offsets, links = self.levels[0]
        self.turn += 1
        seen, turn = self.seen, self.turn
        seen[at] = turn
        open_, kept = [(-best, at)], [(best, at)]
        while open_:
            distance, at = heapq.heappop(open_)
            if len(kept) >= WIDTH and -distance < kept[0][0]:
                break
            around = links[offsets[at] : offsets[at + 1]]
            around = around[seen[around] != turn]
            if not len(around):
                continue
            seen[around] = turn
            near = self.unit[around] @ unit
            if len(kept) >= WIDTH:
                better = near > kept[0][0]
                around, near = around[better], near[better]
            for s, j in zip(near.tolist(), around.tolist()):
                if len(kept) < WIDTH:
                    heapq.heappush(kept, (s, j))
                elif s > kept[0][0]:
                    heapq.heapreplace(kept, (s, j))
                else:
                    continue
                heapq.heappush(open_, (-s, j))
        return np.array([j for _, j in kept])

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """(id, cosine) of the k best found, the query's own id left out; ties to smaller ids."""
        norm = math.sqrt(float(query @ query))
        nodes = self.nearest_nodes((query / norm).astype(np.float32))
        scores = (self.vectors[nodes] @ query) / (self.norms[nodes] * norm)
        found: list[tuple[float, int]] = []
        for i in np.argsort(-scores, kind="stable"):
            if len(found) >= k and scores[i] < -found[k - 1][0]:
                break
            copies = self.ids[self.starts[nodes[i]] : self.starts[nodes[i] + 1]]  # in order of id
            found += [(-float(scores[i]), int(c)) for c in copies[: k + 1] if c != query_id]
            found.sort()
        return [(c, -s) for s, c in found[:k]]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vector, dim) of the rows that take part, as doubles: no null, empty, zero or non-finite vectors and no null ids. A row that
    repeats another's id and vector counts once. Vectors whose squares leave the range of doubles are scaled by their largest component,
    which changes no cosine."""
    vector = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), vector.alias("vector")).where("id is not null and size(vector) > 0")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vector", lambda x: x == 0)
    largest = F.array_max(F.transform("vector", F.abs))
    scaled = F.when(largest.between(1e-100, 1e100), F.col("vector")).otherwise(F.transform("vector", lambda x: x / largest))
    return rows.where(~odd).where(~zero).distinct().select("id", scaled.alias("vector"), F.size("vector").alias("dim"))


def _builder(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    graph = Graph.build(rows["id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()).astype(float), seed=int(key[1]))
    return pd.DataFrame([{"dim": key[0], "shard": key[1], **graph.row()}])


def _searcher(k: int):
    def search(key: tuple, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        graph = Graph.read(index.iloc[0]) if len(index) else None
        rows: list[tuple] = []
        for query_id, vector in zip(queries["id"], queries["vector"]) if graph else ():
            rows += [(query_id, c, s) for c, s in graph.search(int(query_id), np.asarray(vector, float), k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def _shards(rows: DataFrame, per_shard: int) -> DataFrame:
    """(dim, shards): one row per dimension that occurs; vectors are compared within a dimension."""
    return rows.groupBy("dim").agg(F.ceil(F.count("*") / per_shard).cast("long").alias("shards"))


def build_index(rows: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The graphs of ``usable`` rows, one row per shard."""
    counts = staged(_shards(rows, rows_per_shard))
    total = counts.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = rows.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("id"), "shards")).drop("shards")
    return staged(dealt.repartition(max(1, 4 * total), "dim", "shard").groupBy("dim", "shard").applyInPandas(_builder, INDEX))


def nearest(queries: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest found over all shards of its dimension, nearest first, ties to the
    smaller id, its own id left out; fewer rows where there are fewer candidates. Blocks of queries meet every shard once."""
    places = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))  # columns of their own, apart from the index's
    blocks = staged(_shards(queries, QUERIES_PER_BLOCK).withColumnRenamed("shards", "blocks"))
    dealt = queries.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks").join(places, "dim")
    spread = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    tasks = max(1, 4 * spread.select("dim", "shard", "block").count())
    keys = ["dim", "shard", "block"]
    pairs = dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(spread.repartition(tasks, *keys).groupBy(*keys))
    found = pairs.applyInPandas(_searcher(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
