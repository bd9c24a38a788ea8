"""SentencePiece encoding and decoding, exact, without running all merges of a text.

A merge-type vocabulary has one encoding of a text whose adjacent tokens are all compatible, that is, whose texts put together
merge back into the same two tokens; it is the one that merging finds. It is built from the left by backtracking: at each
position the longest token that an Aho-Corasick automaton found there is tried first, then its shorter prefixes; a token is taken
if it is compatible with the one before. Positions from which nothing fits are kept in a bitfield and never tried again, so that
the work grows with the length of the text.

No token reaches from a letter into the blank after it, or into a sign that no piece has after a letter. Words are therefore encoded one
by one, and common words are remembered.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import process_store, put_columns

BLANK = "▁"  # stands for a blank inside pieces
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
SIGNS = ".,;:!?)|"
MEMO_WORDS, MEMO_PAIRS, LONGEST_MEMO = 300_000, 1_000_000, 64
TEXTS_PER_BATCH = 64
BROKEN = "tablemill.each"  # error handler: one replacement character for each byte that is not UTF-8

codecs.register_error(BROKEN, lambda e: ("�" * (e.end - e.start), e.end))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """The vocabulary of a merge-type model with byte fallback and without symbols of the user's own.

    Ids from ``size`` on are characters that occur in pieces without being one; they leave as their bytes.
    """

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size, self.end, self.unknown = self.model.get_piece_size(), self.model.eos_id(), self.model.unk_id()
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(self.size)]
        is_byte = [self.model.is_byte(i) for i in range(self.size)]
        self.piece = [self.model.id_to_piece(i) for i in range(self.size)]
        self.byte_id = {int(self.piece[i][1:-1], 16): i for i in range(self.size) if is_byte[i]}
        mergeable = [i for i in range(self.size) if not (special[i] or is_byte[i] or self.model.is_unused(i))]
        self.score = {self.piece[i]: self.model.get_score(i) for i in mergeable}
        self.alphabet = frozenset("".join(self.score))
        #: what each id stands for when it is decoded
        self.surface = [
            bytes([int(p[1:-1], 16)]) if b else b"" if s else p.replace(BLANK, " ").encode()
            for p, b, s in zip(self.piece, is_byte, special)
        ]
        self.surface[self.unknown] = " ⁇ ".encode()
        ids = {self.piece[i]: i for i in mergeable if self.merged(self.piece[i]) == [self.piece[i]]}
        for letter in sorted(self.alphabet.difference(ids)):
            ids[letter] = len(self.piece)
            self.piece.append(letter)
        self.length = [len(p) for p in self.piece]
        self.automaton = ahocorasick.Automaton()
        for piece, i in ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: the next shorter token that a token begins with, or -1
        self.shorter = [-1] * len(self.piece)
        for piece, i in ids.items():
            self.shorter[i] = next((ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in ids), -1)
        #: no piece goes on with a blank after another character, so a token ends before every blank that follows one
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.score)
        beside = {pair for p in self.score for pair in zip(p, p[1:])}
        #: signs that no piece has right after a letter: a token ends there as well
        signs = "".join(x for x in SIGNS if not any((letter, x) in beside for letter in LETTERS))
        at_sign = f"|(?<=[{re.escape(LETTERS)}])(?=[{re.escape(signs)}])" if signs else ""
        self.cuts = re.compile(f"(?<=[^{BLANK}])(?={BLANK}){at_sign}") if self.by_word else None
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                worth = score.get(parts[i] + parts[i + 1])
                if worth is not None and (best is None or worth > best):
                    best, at = worth, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' texts put together merge back into the two tokens. The answer is remembered."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        a, b = self.piece[left], self.piece[right]
        fits = self.pairs[left * len(self.piece) + right] = self.merged(a + b) == [a, b]
        return fits

    def tokens(self, text: str) -> list[int]:
        """The encoding of a text of the alphabet."""
        length, shorter, known, width = self.length, self.shorter, self.pairs.get, len(self.piece)
        longest = [-1] * len(text)
        for last, token in self.automaton.iter(text):  # ends come in order: the longest match at a start comes last
            longest[last - length[token] + 1] = token
        failed = bytearray(len(text) // 8 + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            end = at + length[token]
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = known(taken[-1] * width + token) if taken else True
                if fits or (fits is None and self.compatible(taken[-1], token)):
                    taken.append(token)
                    at, token = end, longest[end] if end < len(text) else -1
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: the token before must be another one
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at, token = at - length[last], shorter[last]
        return taken

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a part of a normalised text between sure token ends; characters outside the alphabet as their bytes."""
        known = self.memo.get(text)
        if known is not None:
            return known
        ids: list[int] = []
        start = 0
        if self.alphabet.issuperset(text):
            ids = self.tokens(text)
        else:
            for at, letter in enumerate(text):
                if letter not in self.alphabet:
                    ids += self.tokens(text[start:at]) if start < at else ()
                    ids += self.fallback(letter)
                    start = at + 1
            ids += self.tokens(text[start:]) if start < len(text) else ()
        if ids and max(ids) >= self.size:
            ids = [j for i in ids for j in ([i] if i < self.size else self.fallback(self.piece[i]))]
        known = tuple(ids)
        if len(text) <= LONGEST_MEMO:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[text] = known
        return known

    def fallback(self, letter: str) -> list[int]:
        return [self.byte_id[b] for b in letter.encode()] if self.byte_id else [self.unknown]

    def encode(self, text: str) -> list[int]:
        """Ids of a text with the end id."""
        ids = self.normalised_ids(self.model.normalize(text)) if text else []
        ids.append(self.end)
        return ids

    def normalised_ids(self, text: str) -> list[int]:
        """Ids of a normalised text, or of a part of one between sure token ends."""
        ids: list[int] = []
        get, word = self.memo.get, self.word
        for part in self.cuts.split(text) if self.cuts else [text]:
            known = get(part)
            ids += known if known is not None else word(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", BROKEN)
        return text[1:] if ids and self.piece[ids[0]].startswith(BLANK) else text


def codec(model: str) -> PieceCodec:
    """The codec of a model file, made once in a worker process."""
    store = process_store("piece_codecs")
    if model not in store:
        store[model] = PieceCodec(model)
    return store[model]


def encode_pieces(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids`` (the end id last) and ``piece_text`` (the ids decoded again) as new last columns.

    model: file of a merge-type model, at the same path on all machines. A null text counts as empty: the end id alone. Repeated
    rows keep their place, and input columns named like the new ones give way. Rows stay in their partitions; nothing is shuffled.
    """
    path = model or default_model()
    base = put_columns(docs, __piece_input=F.coalesce(F.col(text), F.lit("")))
    base = base.drop(*[c for c in base.columns if c.lower() in ("piece_ids", "piece_text")])
    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_text", T.StringType())]
    schema = T.StructType([f for f in base.schema.fields if f.name != "__piece_input"] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_PER_BATCH):
                batch = whole.slice(start, TEXTS_PER_BATCH)
                ids = [pieces.encode(t) for t in batch.column("__piece_input").to_pylist()]
                texts = [pieces.decode(i) for i in ids]
                columns = [batch.column(n) for n in schema.names[:-2]] + [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(run, schema)
