"""Toxicity through a noisy channel.

Writers hide words behind look-alike characters, separators, spaced letters and repetition. Each noisy token spans a lattice of
readings; a Viterbi search under a character trigram model of the whole corpus picks one; the restored text is scored by a
logistic model over its words and word beginnings, learned from labelled rows.

What the driver holds is bounded: the trigram table by the alphabet, the model by ``FEATURES``, the labelled sample by ``FIT_ROWS``.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import process_store, staged

FEATURES = 2_000  # features of the model: those that tell the classes apart best
FIT_ROWS = 40_000  # labelled rows that the logistic model is fitted on at most, about: those with the lowest hashes of the id; features are counted on all
MIN_TOXIC = 4  # labelled toxic documents that a feature must occur in
PREFIXES = (3, 4, 5, 6, 7)  # lengths of word beginnings
MEMO_TOKENS, MEMO_WHOLE = 100_000, 300_000
TEXTS_AT_ONCE = 250  # texts whose features a task holds at a time
MEMO_LENGTH = 64  # readings of longer tokens are not remembered

# The alphabet of the character model (a-z and the lower-case letters of Latin-1), and what look-alikes may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c) != "÷")
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}

EDGE = len(LETTERS)  # word boundary
OTHER = EDGE + 1  # any other character
SYMBOLS = OTHER + 1
CODE = {c: i for i, c in enumerate(LETTERS)}

WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<![^\s])(?:[^\s][ .\-_*]+){2,}[^\s](?![^\s])")
JUNK = ".,;:?!%*#&~^<>\"'()[]{}"  # at a token's ends it is no letter, unless it is a look-alike
PLAIN_JUNK = "".join(c for c in JUNK if c not in LOOKALIKES)
SIGNS = "".join(LOOKALIKES)
ONE_READING = str.maketrans({c: r for c, r in LOOKALIKES.items() if len(r) == 1})
DOUBLED = re.compile(r"([^\W\d_])\1")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
LAST_BMP = 0x10000


def _codes(text: str) -> np.ndarray:
    """Symbols of a text; white space is the word boundary."""
    table = _codes.__dict__.get("table")
    if table is None:
        table = np.full(LAST_BMP, OTHER, np.int64)
        for c, i in CODE.items():
            table[ord(c)] = i
        for c in " \t\n\r\x0b\x0c":
            table[ord(c)] = EDGE
        _codes.table = table
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table[np.minimum(points, LAST_BMP - 1)]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0):
            codes = _codes(f"  {(text.as_py() or '').lower()} ")
            total += 0 if len(codes) < 3 else np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log p(c | a, b) as a cube over symbols, from all texts; interpolated with shorter contexts. At most SYMBOLS cubed rows reach the driver."""
    counts = docs.select(text).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    cube = np.zeros(SYMBOLS**3)
    cube[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(float)
    cube = cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = cube.sum(0)
    one = two.sum(0) + 0.5
    p1 = one / one.sum()
    p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
    p3 = (cube + 2 * p2[None]) / (cube.sum(2, keepdims=True) + 2)
    return np.log(p3).astype(np.float32)


# Channel: log odds against reading a character as it stands.
SUBSTITUTE, DROP, DROP_LOOKALIKE, BREAK, DOUBLE, SQUEEZE = -1.0, -2.0, -7.0, -9.0, -3.0, -0.5
JOINED = -1.0  # the end of a word between the letters of a spaced run


class Decoder:
    """Restores noisy tokens. A clean token (letters, none twice in a row) stands for itself. Where look-alikes at a token's ends may be letters
    or junk, or a doubled letter one or two, both readings count. Tokens of any length are read, in time linear in their length."""

    def __init__(self, model: np.ndarray):
        known = process_store("toxicity_decoder")  # of the last model that a task of this process has used
        mark = hashlib.sha256(np.ascontiguousarray(model).tobytes()).digest()
        if known.get("mark") != mark:
            known.update(mark=mark, model=model.tolist())
        # what a task has read goes with it: the worker process lives on into stages that need the memory
        self.model, self.memo, self.tokens = known["model"], {}, {}

    def words(self, text: str) -> Counter:
        """Restored words of a text with their counts."""
        text = text.lower()
        found: Counter = Counter()
        count, known = found.get, self.tokens.get
        for token, n in Counter(text.split()).items():
            words = known(token)
            for word in self.token_words(token) if words is None else words:
                found[word] = count(word, 0) + n
        for word in self.spaced_words(text):
            found[word] += 1
        return found

    def spaced_words(self, text: str) -> Iterator[str]:
        """Words of letters set apart in a lower-case text: one word or several, next to what the letters gave as tokens."""
        for run in SPACED.findall(text):
            letters = re.sub(r"[\s.\-_*]+", "", run)
            if len(set(letters)) > 1:
                yield from self.together([self.restore(letters), self.restore(letters, parted=True)])

    def token_words(self, token: str) -> tuple[str, ...]:
        """Words of a token without white space. Those of tokens that are not too long are remembered."""
        words = self.read(token)
        if len(token) <= MEMO_LENGTH:
            if len(self.tokens) >= MEMO_WHOLE:
                self.tokens.clear()
            self.tokens[token] = words
        return words

    def read(self, token: str) -> tuple[str, ...]:
        core = token if token.isalpha() else token.strip(PLAIN_JUNK)
        if core.isalpha() and not DOUBLED.search(core):
            return (core,)
        return tuple(self.readings(core)) if core else ()

    def readings(self, core: str) -> list[str]:
        """Words of a token without white space, those of its other readings after them; words that the first reading has are not repeated."""
        bare = core if core.isalpha() else core.strip(JUNK)
        if bare.endswith("$$"):
            bare = bare.rstrip("$")
        ways, twice = [], DOUBLED.search(bare)
        if bare.isalpha():
            stretched = twice and TRIPLE.search(bare)
            if not stretched:
                ways.append(bare)
            if twice:
                ways.append(self.restore(bare) if stretched or DOUBLED.search(bare, twice.end()) else self.halved(bare, twice.start()))
        elif any(map(str.isalpha, bare)):
            ways.append(self.restore(bare))
        if core[0] in LOOKALIKES or core[-1] in LOOKALIKES:
            if bare.isalpha() and not twice and all(len(LOOKALIKES.get(c, " ")) == 1 for c in core) and core.strip(SIGNS) == bare:
                ways.append(core.translate(ONE_READING))  # the only path
            else:
                ways.append(self.restore(core, ends=True))
        return self.together(ways)

    def halved(self, token: str, at: int) -> str:
        """The better path of a token of letters with one doubled letter, at and at + 1."""
        a, b, c, d, e = (CODE.get(token[i], OTHER) if 0 <= i < len(token) else EDGE for i in range(at - 1, at + 4))
        model = self.model
        both = model[a][b][c] + model[b][c][d] + (model[c][d][e] if at + 2 < len(token) else 0.0)
        one = model[a][b][d] + (model[b][d][e] if at + 2 < len(token) else 0.0)
        return token[:at] + token[at + 1 :] if one + DOUBLE > both else token

    @staticmethod
    def together(ways: list[str]) -> list[str]:
        found: list[str] = []
        for way in ways:
            more = [way] if way.isalpha() else WORD.findall(way)
            found += [w for w in more if w not in found] if found else more
        return found

    def restore(self, token: str, ends: bool = False, parted: bool = False) -> str:
        if not token or len(token) > MEMO_LENGTH:
            return token and self.viterbi(token, ends, parted)
        if len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
        known = self.memo.get((token, ends, parted))
        if known is None:
            known = self.memo[(token, ends, parted)] = self.viterbi(token, ends, parted)
        return known

    def viterbi(self, token: str, ends: bool = False, parted: bool = False) -> str:
        """Best path through the lattice. State: the last two symbols written; a path is a chain of pairs (path so far, character).

        ends: the look-alikes at both ends are letters. parted: a word may end between any two characters."""
        model = self.model
        first, last = (len(token) - len(token.lstrip(SIGNS)), len(token.rstrip(SIGNS))) if ends else (0, len(token))
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        before, repeats = "", 0
        for i, c in enumerate(token):
            repeats = repeats + 1 if c == before else 0
            # junk comes in runs; a single look-alike is more likely a letter
            drop = DROP_LOOKALIKE if c in LOOKALIKES and not repeats and token[i + 1 : i + 2] != c else DROP
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            readings = [(r, CODE.get(r, OTHER), SUBSTITUTE) for r in LOOKALIKES.get(c, "")]
            noise = not c.isalpha()
            letter = i < first or i >= last
            if not noise:
                readings.append((c, CODE.get(c, OTHER), 0.0))
            if parted and i:
                best = max(((score + JOINED + model[a][b][EDGE], path) for (a, b), (score, path) in states.items()), key=_score)
                if best[0] > states.get((EDGE, EDGE), NEVER)[0]:
                    states[(EDGE, EDGE)] = (best[0], (best[1], " "))
            for (a, b), (score, path) in states.items():
                row = model[a][b]
                for r, code, cost in readings:
                    new = score + cost + row[code]
                    if new > after.get((b, code), NEVER)[0]:
                        after[(b, code)] = (new, (path, r))
                if noise:  # a separator or junk: dropped, or the end of a word
                    if letter:
                        continue
                    new = score + drop
                    if new > after.get((a, b), NEVER)[0]:
                        after[(a, b)] = (new, path)
                    new = score + BREAK + row[EDGE]
                    if new > after.get((EDGE, EDGE), NEVER)[0]:
                        after[(EDGE, EDGE)] = (new, (path, " "))
                elif c == before:  # a repeated letter: dropped
                    new = score + (DOUBLE if repeats == 1 else SQUEEZE)
                    if new > after.get((a, b), NEVER)[0]:
                        after[(a, b)] = (new, path)
            states, before = after, c
        path = max(((score + model[a][b][EDGE], path) for (a, b), (score, path) in states.items()), key=_score)[1]
        written: list[str] = []
        while path:
            path, c = path
            written.append(c)
        return "".join(reversed(written))


NEVER = (-math.inf, None)


def _score(state: tuple) -> float:
    return state[0]


def features(words: dict[str, int]) -> Counter:
    """Counts of whole words ('=word') and of word beginnings ('wor')."""
    found: Counter = Counter()
    for word, n in words.items():
        found["=" + word] += n
        for k in PREFIXES:
            if len(word) > k:
                found[word[:k]] += n
    return found


def feature_names(words: dict[str, int]) -> set[str]:
    """The features that occur at all."""
    found = {"=" + w for w in words}
    for k in PREFIXES:
        found.update({w[:k] for w in words if len(w) > k})
    return found


class Matcher:
    """Counts the features of a fixed list in texts. What a token has of them is remembered; most have none."""

    def __init__(self, names: list[str], decoder: Decoder):
        self.names = set(names)
        self.starts = {n.removeprefix("=")[:3] for n in names}
        self.decoder = decoder
        self.tokens: dict[str, tuple[str, ...]] = {}

    def of_words(self, words: Iterable[str]) -> tuple[str, ...]:
        found: list[str] = []
        for word in words:
            if word[:3] in self.starts:
                found += [f for f in ("=" + word, *[word[:k] for k in PREFIXES if len(word) > k]) if f in self.names]
        return tuple(found)

    def of_token(self, token: str) -> tuple[str, ...]:
        found = self.of_words(self.decoder.read(token))
        if len(token) <= MEMO_LENGTH:
            if len(self.tokens) >= MEMO_WHOLE:
                self.tokens.clear()
            self.tokens[token] = found
        return found

    def __call__(self, text: str) -> dict[str, int]:
        text = text.lower()
        found: dict[str, int] = {}
        known = self.tokens.get
        for token, n in Counter(text.split()).items():
            here = known(token)
            if here is None:
                here = self.of_token(token)
            for f in here:
                found[f] = found.get(f, 0) + n
        for f in self.of_words(self.decoder.spaced_words(text)):
            found[f] = found.get(f, 0) + 1
        return found


def _feature_counts(cube: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(cube)
        for batch in (whole.slice(start, TEXTS_AT_ONCE) for whole in batches for start in range(0, whole.num_rows, TEXTS_AT_ONCE)):
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                by[toxic].update(feature_names(decoder.words(text.as_py() or "")))
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([by[0][f] for f in names], pa.int64()), pa.array([by[1][f] for f in names], pa.int64())],
                names=["feature", "clean", "toxic"],
            )

    return count


def _vectors(cube: np.ndarray, names: list[str]):
    index = {f: i for i, f in enumerate(names)}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(names, Decoder(cube))
        for batch in batches:
            found = [match(text.as_py() or "") for text in batch.column(0)]
            hits = [sorted(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([[index[h] for h in hit] for hit in hits], pa.list_(pa.int32())),
                    pa.array([[math.log1p(f[h]) for h in hit] for f, hit in zip(found, hits)], pa.list_(pa.float32())),
                ],
                names=["toxic", "at", "value"],
            )

    return make


@dataclass
class ToxicityModel:
    characters: np.ndarray
    names: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self):
        weight = dict(zip(self.names, self.weights.tolist()))
        bias, cube, names = self.bias, self.characters, self.names

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(names, Decoder(cube))
            for batch in batches:
                scores = []
                for text in batch.column(batch.num_columns - 1):
                    found = match(text.as_py() or "")
                    z = bias + sum(weight[f] * math.log1p(found[f]) for f in sorted(found))
                    scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])
            pa.default_memory_pool().release_unused()

        return score


def _fit(at: list, value: list, y: np.ndarray, size: int, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by full-batch adaptive gradient steps."""
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    cols = np.concatenate([np.asarray(a, np.int64) for a in at]) if len(rows) else np.empty(0, np.int64)
    vals = np.concatenate([np.asarray(v, float) for v in value]) if len(rows) else np.empty(0)
    w, b = np.zeros(size), 0.0
    square, square_b = np.full(size, 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(rows, vals * w[cols], len(at))
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        g, g_b = np.bincount(cols, vals * miss[rows], size) + l2 * w, miss.sum()
        square, square_b = square + g * g, square_b + g_b * g_b
        w, b = w - 0.3 * g / np.sqrt(square), b - 0.3 * g_b / math.sqrt(square_b)
    return w, float(b)


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labelled: DataFrame, text: str = "text") -> ToxicityModel:
    """``docs``: all texts, for the character model. ``labelled``: text, toxic (0 or 1) and id to learn from; rows with a null label are left out.

    With no row of one class the model says how frequent the other is: score 0 without toxic rows, 1 without clean ones, 0.5 without any.
    """
    cube = character_model(docs, text)
    known = staged(labelled.where("toxic in (0, 1)").select(F.col(text).alias("text"), F.col("toxic").cast("int").alias("toxic"), "id"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(cube, [], np.zeros(0), 0.0 if n0 == n1 else (500.0 if n1 else -500.0))
    counted = known.select("text", "toxic").mapInArrow(_feature_counts(cube), "feature string, clean long, toxic long")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= MIN_TOXIC)
    p = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    gap = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    best = counted.withColumn("gap", gap).where("gap > 0").orderBy(F.desc("gap"), "feature").limit(FEATURES)
    names = [r["feature"] for r in best.select("feature").collect()]
    share = min(1.0, FIT_ROWS / (n0 + n1))  # the rows whose ids hash lowest
    sample = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    fitted = sample.select("text", "toxic").mapInArrow(_vectors(cube, names), "toxic int, at array<int>, value array<float>").toPandas()
    weights, bias = _fit(list(fitted["at"]), list(fitted["value"]), fitted["toxic"].to_numpy(float), len(names))
    return ToxicityModel(cube, names, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where score >= threshold). Null and empty texts get the score of a text without words.

    Input columns named like the new ones give way; all other columns and repeated rows stay.
    """
    ready = docs.withColumn("__text", F.col(text))
    ready = ready.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    scored = ready.mapInArrow(model.scorer(), f"{fields}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their labels, without held-out ids. An id with several labels counts as toxic where any says so."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.hint("merge")  # labels grow with the corpus and are not broadcast at any size
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic", F.col("doc_id").alias("id"))
