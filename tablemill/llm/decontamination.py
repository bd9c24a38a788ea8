"""Benchmark decontamination by BM25 over an inverted index of the test items, with block-max WAND.

The index holds the items, in parts of bounded length, and every passage of the training texts is a query. A part's BM25 is divided by
the score of the part itself, so one threshold fits all: 1 means that a passage holds all of its terms. Parts are numbered in blocks; for
each term the index knows its largest contribution in each block, and only blocks in which those maxima of a passage's terms add up
to the threshold are scored. Everything scored above it is checked word by word: question and answer must both be there.

Items are searched in shards of about ``ITEMS_PER_SHARD``, so what is sent to the executors is bounded; texts are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
PART_WORDS = 32  # longest part; passages are twice as long and start every PART_WORDS words, so that each stretch of a part's length lies in one
ITEMS_PER_SHARD = 512
BLOCK = 8  # parts of a block
TEXTS_AT_ONCE = 256  # rows of a batch that a task gives back
K1, B = 1.2, 0.75
THRESHOLD = 0.6  # share of a part's own score that a passage must reach
SHINGLE = 5
OVERLAP = 0.8  # share of the question's and of the answer's shingles that must be in the text around the passage


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words as question and answer: cut after the last question mark, else at an answer line, else before the last sentence,
    else before the last third."""
    for pattern in (r".*\?(?=.*\w)", r".*(?=\n\s*answer\b)", r".*[.!:;\n](?=\s*\w)"):
        found = re.match(pattern, text, re.S | re.I)
        if found and words_of(found[0]):
            return words_of(found[0]), words_of(text[found.end() :])
    words = words_of(text)
    cut = max(1, len(words) - len(words) // 3)
    return words[:cut], words[cut:]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def item_shingles(question: list[str], answer: list[str]) -> tuple[int, set, set]:
    """Shingles of the question and of the answer, and their size; a part with fewer words takes what it lacks from the other, as they
    follow each other. An item of fewer words than a shingle is one shingle as a whole."""
    size = min(SHINGLE, len(question) + len(answer))
    lack = size - min(size, len(question)), size - min(size, len(answer))
    return size, shingles(question + answer[: lack[0]], size), shingles(question[max(0, len(question) - lack[1]) :] + answer if answer else [], size)


def item_parts(words: list[str]) -> list[Counter]:
    """Term counts of the parts of an item."""
    count = math.ceil(len(words) / PART_WORDS)
    size = math.ceil(len(words) / max(1, count))
    return [Counter(words[start : start + size]) for start in range(0, len(words), max(1, size))]


class Statistics:
    """Over the parts of all items: their number, their words and in how many each term occurs. Grows with the benchmark's vocabulary."""

    def __init__(self) -> None:
        self.parts = self.words = 0
        self.held: Counter = Counter()

    def add(self, text: str) -> None:
        for part in item_parts(words_of(text)):
            self.parts += 1
            self.words += sum(part.values())
            self.held.update(part.keys())


class Index:
    """Postings of one shard, by block: terms, parts and shares of the part's own score; and of each term its maxima by block."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        if statistics is None:
            statistics = Statistics()
            for _, text in items:
                statistics.add(text)
        parts, self.item_of = [], []
        self.items = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            self.items.append((item_id, len(words), *item_shingles(*question_and_answer(text))))
            for part in item_parts(words):
                parts.append(part)
                self.item_of.append(len(self.items) - 1)
        lengths = [sum(p.values()) for p in parts]
        mean = statistics.words / statistics.parts if statistics.parts else 1
        idf = {t: math.log1p((statistics.parts - n + 0.5) / (n + 0.5)) for t, n in ((t, statistics.held[t]) for t in {t for p in parts for t in p})}
        postings = defaultdict(list)
        for i, (p, length) in enumerate(zip(parts, lengths)):
            worth = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean)) for t, n in p.items()}
            own = sum(worth.values())
            for t, w in worth.items():
                postings[t].append((i, w / own))
        self.terms = {t: i for i, t in enumerate(sorted(postings))}
        blocks = math.ceil(len(parts) / BLOCK)
        self.maxima = np.zeros((len(self.terms), blocks), np.float32)
        rows = sorted((part // BLOCK, self.terms[t], part % BLOCK, w) for t, row in postings.items() for part, w in row)
        for block, term, _, w in rows:
            self.maxima[term, block] = max(self.maxima[term, block], w)
        cuts = np.searchsorted([r[0] for r in rows], np.arange(blocks + 1))
        self.blocks = [tuple(np.array(c) for c in list(zip(*rows[a:b]))[1:]) for a, b in zip(cuts[:-1], cuts[1:])]  # terms, parts, contributions
        self.asked = np.zeros(len(self.terms), bool)

    def scored(self, terms: np.ndarray, block: int) -> np.ndarray:
        """Scores of a block's parts."""
        held, part, worth = self.blocks[block]
        self.asked[terms] = True
        hit = self.asked[held]
        self.asked[terms] = False
        return np.bincount(part[hit], worth[hit], BLOCK)

    def retrieve(self, words: list[str], threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of every passage and part at or above the threshold."""
        known = self.terms
        ids = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        segment, n = at // PART_WORDS, len(known)
        pairs = np.unique(np.concatenate([segment * n + ids[at], (np.maximum(segment, 1) - 1) * n + ids[at]]))  # passage k: segments k and k + 1
        passage, term = pairs // n, pairs % n
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        bounds = np.add.reduceat(self.maxima[term], first, axis=0)
        ends = np.r_[first[1:], len(pairs)]
        for row, block in zip(*np.nonzero(bounds >= threshold - 1e-5)):
            scores = self.scored(term[first[row] : ends[row]], int(block))
            for part in np.flatnonzero(scores >= threshold - 1e-9):
                yield int(passage[first[row]]), self.item_of[block * BLOCK + part], float(scores[part])

    def leaks(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[dict]:
        """Items whose question and answer are both in the text, near a passage that retrieved them."""
        words = words_of(text)
        found: dict[int, tuple] = {}
        around: dict[tuple[int, int, int], set] = {}
        for passage, item, score in self.retrieve(words, threshold):
            item_id, length, size, question, answer = self.items[item]
            start, stop = max(0, passage * PART_WORDS - length), (passage + 2) * PART_WORDS + length
            near = around.get((start, stop, size))
            if near is None:
                near = around[(start, stop, size)] = shingles(words[start:stop], size)
            of_question = len(question & near) / len(question)
            of_answer = len(answer & near) / len(answer) if answer else 1.0
            if of_question >= overlap and of_answer >= overlap:
                found[item] = max(found.get(item, (0.0,)), (score, of_question, of_answer))
        return [
            {"item_id": self.items[i][0], "score": s, "question": q, "answer": a}
            for i, (s, q, a) in sorted(found.items(), key=lambda entry: (self.items[entry[0]][0] is None, self.items[entry[0]][0] or 0))
        ]


LEAKS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def _matcher(index: Index, place: int, threshold: float, overlap: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):  # rows go back in small batches, which take little memory on both sides
                batch = whole.slice(start, TEXTS_AT_ONCE)
                found = [index.leaks(text.as_py(), threshold, overlap) for text in batch.column(place)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "leaks"])

    return match


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` with leaks: the benchmark items (item_id, text) found in each text, by item_id, with the best passage's score and the shares
    of the question's and the answer's five-word shingles that are there.

    Null and empty texts have no leaks; items without words are not searched, and of items below five words the whole sequence must be
    there; items that repeat an id are searched each. Repeated rows and other columns stay; an input column named leaks gives way. Term
    weights are those over all items, which the driver reads shard by shard. Each shard of items takes one pass over the texts.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    shards = max(1, math.ceil(items.count() / ITEMS_PER_SHARD))
    found = docs.drop(*[c for c in docs.columns if c.lower() == "leaks"])
    found = found.withColumn("leaks", F.array().cast(LEAKS))
    parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).orderBy("item_id", "text") for shard in range(shards)]
    statistics = Statistics()
    for part in parts:
        for row in part.collect():
            statistics.add(row["text"])
    for part in parts:
        index = Index([(r["item_id"], r["text"]) for r in part.collect()], statistics)
        ready = found.withColumnRenamed("leaks", "__before")
        place = [c.lower() for c in ready.columns].index(text.lower())
        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields)
        found = ready.mapInArrow(_matcher(index, place, threshold, overlap), f"{fields}leaks {LEAKS}")
        found = found.withColumn("leaks", F.sort_array(F.concat("__before", "leaks"))).drop("__before")
    return found
