"""Alignment of the tokens of two tokenizers over the same text.

The tokens of both tokenizers are byte intervals. All of them, of many texts at once, are sorted by their starts; a running maximum
of their ends tells where a group of intervals that hang together stops: where a start reaches it, both tokenizers have a token end.
Inside the groups overlapping pairs are expanded, and pairs that end together are links.

The intervals are taken word by word: both tokenizers end a token before a single blank between two visible characters, so that a
text's alignment is that of its words put together, and common words are aligned once in a worker process.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import process_store, put_columns, staged
from tablemill.llm.pieces import BLANK, PieceCodec, codec, default_model
from tablemill.llm.tokens import default_tokenizer

# Where every version of the byte-level splitting rule cuts, and no piece of the other vocabulary reaches across.
CUT = re.compile(r"(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")
VISIBLE = frozenset(map(chr, [*range(ord("!"), ord("~") + 1), *range(ord("À"), ord("ɏ") + 1)]))
MEMO_WORDS, TEXTS_PER_BATCH, CHARS_PER_CALL = 200_000, 64, 200_000
COLUMNS = {
    "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_overlaps": T.LongType(), "n_links": T.LongType(),
    "groups": T.StringType(), "link_pairs": T.ArrayType(T.LongType()), "link_counts": T.ArrayType(T.IntegerType()),
}


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Aligner:
    """Tokenizer A is a byte-level file of the ``tokenizers`` library, B a piece model that puts a blank before the text."""

    def __init__(self, tokenizer: str, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b: PieceCodec = codec(model)
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b.surface], dtype=np.int64)
        before = self.a.pre_tokenizer
        plain = type(before).__name__ == "ByteLevel" and self.a.normalizer is None and not before.add_prefix_space
        self.by_word = plain and self.b.by_word
        #: ids as text with the sign after them: A followed by A, A by B, B by B, the last of a group
        self.sizes = (len(self.a_bytes), 2 * len(self.a_bytes), self.b.size)
        self.spelled = [f"{i}{sign}" for size, signs in ((len(self.a_bytes), ",|"), (self.b.size, ",;")) for sign in signs for i in range(size)]
        self.memo: dict[str, tuple[bytes, str, bytes] | None] = {}

    def parts(self, text: str) -> list[str] | None:
        """The parts of blank + text that are aligned on their own; None where B does not see the same characters."""
        spaced = " " + text
        if not text or self.b.model.normalize(text).replace(BLANK, " ") != spaced:
            return None
        return CUT.split(spaced) if self.by_word else [spaced]

    def learn(self, parts: list[str]) -> None:
        """Put the alignment of each part into the memo: its counts, its groups as text and its links; None where bytes differ.

        Parts that begin with one blank and end visibly are encoded as one text, since tokens end between them.
        """
        chained = [p for p in parts if self.by_word and len(p) > 1 and p[0] == " " and p[1] in VISIBLE and p[-1] in VISIBLE]
        if chained:
            text = "".join(chained)
            a = self.a.encode(text, add_special_tokens=False).ids
            if not self.keep(chained, a, self.b.model.encode(text[1:], num_threads=1)):
                chained = []
        known = set(chained)
        for part in parts:
            if part not in known:
                a = self.a.encode(part, add_special_tokens=False).ids
                if not self.keep([part], a, self.b.normalised_ids(part.replace(" ", BLANK))):
                    self.memo[part] = None

    def keep(self, parts: list[str], a_ids: list[int], b_ids: list[int]) -> bool:
        """Remember the alignment of parts whose tokens are given one after the other; False where bytes differ or no token ends."""
        raw = [p.encode() for p in parts]
        whole = b"".join(raw)
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b.surface.__getitem__, b_ids)) != whole:
            return False
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_start, b_start = a_end - self.a_length[a], b_end - self.b_length[b]
        part_end = np.cumsum([len(r) for r in raw])
        a_cut, b_cut = np.searchsorted(a_end, part_end, "right"), np.searchsorted(b_end, part_end, "right")
        if (a_end[a_cut - 1] != part_end).any() or (b_end[b_cut - 1] != part_end).any():
            return False
        first_a, first_b = groups_of(a_start, a_end, b_start, b_end)
        link_a, link_b, ends = overlaps(a_start, a_end, b_start, b_end)
        # what each part has, from the running numbers at its end
        group_cut = np.searchsorted(first_a, a_cut, "left")
        overlap_cut = np.searchsorted(link_a, a_cut, "left")
        link_cut = np.concatenate([[0], np.cumsum(ends)])[overlap_cut]
        ran = np.stack([a_cut, b_cut, group_cut, overlap_cut, link_cut], axis=1).astype(np.int64)
        counts = np.diff(ran, axis=0, prepend=0).tobytes()
        codes = (a[link_a[ends]] * self.b.size + b[link_b[ends]]).tobytes()
        # groups in one row of tokens, each with the sign that follows it
        places = np.empty(len(a) + len(b), dtype=np.int64)
        places[np.arange(len(a)) + np.repeat(first_b[:-1], np.diff(first_a))] = a + np.where(np.isin(np.arange(1, len(a) + 1), first_a), self.sizes[0], 0)
        b_sign = b + self.sizes[1] + np.where(np.isin(np.arange(1, len(b) + 1), first_b), self.sizes[2], 0)
        places[np.arange(len(b)) + np.repeat(first_a[1:], np.diff(first_b))] = b_sign
        spelled = [self.spelled[i] for i in places.tolist()]
        t0 = l0 = 0
        for n, (part, t1, l1) in enumerate(zip(parts, (a_cut + b_cut).tolist(), (link_cut * 8).tolist())):
            self.memo[part] = (counts[n * 40 : n * 40 + 40], "".join(spelled[t0:t1]), codes[l0:l1])
            t0, l0 = t1, l1
        return True

    def align(self, texts: list[str]) -> list[tuple]:
        """Values of COLUMNS for each text; no tokens where a text is empty or bytes differ."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        split = [self.parts(t) for t in texts]
        missing = list({p for parts in split if parts for p in parts if p not in self.memo})
        while missing:  # a bounded number of characters at a time, or one part
            size = n = 0
            while n < len(missing) and (n == 0 or size + len(missing[n]) <= CHARS_PER_CALL):
                size += len(missing[n])
                n += 1
            self.learn(missing[:n])
            del missing[:n]
        rows = []
        for parts in split:
            found = [self.memo[p] for p in parts] if parts else [None]
            if None in found:
                rows.append((0, 0, 0, 0, 0, "", [], []))
                continue
            counts = np.frombuffer(b"".join([f[0] for f in found]), dtype=np.int64).reshape(-1, 5).sum(axis=0)
            pairs, times = np.unique(np.frombuffer(b"".join([f[2] for f in found]), dtype=np.int64), return_counts=True)
            rows.append((*counts.tolist(), "".join([f[1] for f in found])[:-1], pairs, times))
        return rows


def groups_of(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval coalescing: the number of A tokens, and of B tokens, before each group, and after the last one."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    is_a = np.concatenate([np.ones(len(a_start), bool), np.zeros(len(b_start), bool)])
    order = np.lexsort((~is_a, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.flatnonzero(np.concatenate([[True], start[order][1:] >= reach[:-1]]))
    before = np.concatenate([[0], np.cumsum(is_a[order])])
    cut = np.concatenate([breaks, [len(order)]])
    return before[cut], cut - before[cut]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of an A and a B token that share bytes, in the order of A, and whether they end together."""
    low = np.searchsorted(b_end, a_start, "right")
    many = np.searchsorted(b_start, a_end, "left") - low
    left = np.repeat(np.arange(len(a_start)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return left, right, a_end[left] == b_end[right]


def align_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """``docs`` without the text, with its alignment: n_a, n_b (tokens), n_groups, n_overlaps (pairs that share bytes), n_links (pairs
    that end together), groups (ids as ``a1,a2|b1;a3|b2,b3``), link_pairs and link_counts (the distinct linked pairs, as A id times
    the size of B's vocabulary plus B id, and how often each is linked).

    tokenizer and model: files at the same path on all machines. A text that is null or empty, or that one of the tokenizers does not
    give back byte by byte, has no tokens: zeros, no groups. Repeated rows keep their place; input columns named like the new ones
    give way. Rows stay in their partitions.
    """
    a, b = tokenizer or default_tokenizer(), model or default_model()
    base = put_columns(docs, __align_input=F.coalesce(F.col(text), F.lit(""))).drop(text)
    base = base.drop(*[c for c in base.columns if c.lower() in COLUMNS])
    kept = [f for f in base.schema.fields if f.name != "__align_input"]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in COLUMNS.items()])
    types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_store("aligners")
        aligner = store.get((a, b)) or store.setdefault((a, b), Aligner(a, b))
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_PER_BATCH):
                batch = whole.slice(start, TEXTS_PER_BATCH)
                rows = aligner.align(batch.column("__align_input").to_pylist())
                made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, names=schema.names)

    return base.mapInArrow(run, schema)


def with_pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``aligned`` (written once) with n_best, links whose pair is linked most often among all pairs of its B id, ties included, and
    count_sum, the sum over the links of how often their pair is linked in the whole table.

    Counts per pair go to every task. Of two tokens that end together one is a suffix of the other, so there are no more pairs
    than there are suffixes of vocabulary entries (under a million for two vocabularies of 50,000 and 32,000), however many texts.
    """
    rows = staged(aligned)
    link = F.explode(F.arrays_zip("link_pairs", "link_counts")).alias("link")
    counted = rows.select(link).groupBy(F.col("link.link_pairs").alias("pair")).agg(F.sum("link.link_counts").alias("times")).toArrow()
    pair, times = (counted.column(n).to_numpy() for n in ("pair", "times"))
    order = np.argsort(pair)
    pair, times = pair[order], times[order].astype(np.int64)
    top = np.zeros(size_b, np.int64)
    np.maximum.at(top, pair % size_b, times)
    is_best = times == top[pair % size_b]
    schema = T.StructType(rows.schema.fields + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, many = batch.column("link_pairs"), batch.column("link_counts")
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            here = many.flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(pairs.value_lengths().to_numpy())
            best, total = (np.concatenate([[0], np.cumsum(here * v[at])]) for v in (is_best, times))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            made = [pa.array(x[ends] - x[starts], pa.int64()) for x in (best, total)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema)
