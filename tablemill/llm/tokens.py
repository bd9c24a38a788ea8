"""Token counts through a digest cache.

Texts are keyed by the SHA-256 of their content and of the tokenizer; counts that the cache holds are joined, each distinct
text that it lacks is encoded once, and the new counts are appended. Copies of a text meet as digests, never as texts in
one task: each map task keeps one copy before the shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import process_store, put_columns, scratch_path, staged

# Places where every version of the byte-level splitting rule cuts: before one blank or line break between two visible characters.
CUT = re.compile(r"(?<=[!-~À-ɏ])(?=[ \n][!-~À-ɏ])")
MEMO_PIECES = 1_500_000
TEXTS_PER_CALL = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


class Counter:
    """Counts tokens as ``encode`` does, without added special tokens. Counts of pieces between sure cuts add up, so pieces are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.cuts = kind == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        whole = [not self.cuts or any(s in t for s in self.special) for t in texts]
        pieces = [[t] if alone else CUT.split(t) for t, alone in zip(texts, whole)]
        memo = self.memo
        if len(memo) > MEMO_PIECES:
            memo.clear()
        missing = list({p for row in pieces for p in row if p not in memo})
        memo.update(zip(missing, self.encoded(missing)))
        out = [sum(map(memo.__getitem__, row)) for row in pieces]
        for row, alone in zip(pieces, whole):
            if alone:
                memo.pop(row[0], None)
        return out


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_store("token_counters")
        counter = store.get(path)
        if counter is None:
            counter = store[path] = Counter(path)
        for batch in batches:
            texts = batch.column(1)
            counts: list[int] = []
            for start in range(0, len(texts), TEXTS_PER_CALL):
                counts += counter.counts(texts.slice(start, TEXTS_PER_CALL).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return encode


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = None, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer: file of the ``tokenizers`` library, at the same path on all machines. cache: folder of stored counts, kept between calls
    and shared by all tokenizers; without one the counts of this call go to a fresh folder. A null text counts as empty (0 tokens);
    repeated rows keep their place; input columns named like the new ones give way to them.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    version = tokenizer_version(path)
    folder = f"{cache or scratch_path(spark, 'token-counts')}/{version}"
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    distinct = docs.select(digest.alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    if _exists(spark, folder):
        distinct = distinct.join(spark.read.parquet(folder).select("digest"), "digest", "left_anti")
    schema = "digest binary, n_tokens long"
    distinct.select("digest", "content").mapInArrow(_encoder(path), schema).write.mode("append").parquet(folder)
    stored = spark.read.schema(schema).parquet(folder).withColumnRenamed("n_tokens", "__count")
    if cache:  # two calls may have stored one digest; once that is settled, the join below can split a digest that very many rows share
        stored = staged(stored.groupBy("digest").agg(F.min("__count").alias("__count")))
    # the length is taken before the join, so that a caller who drops the text need not shuffle it
    keyed = docs.withColumns({"__digest": digest, "__bytes": F.octet_length(content).cast("long")})
    out = keyed.join(stored.withColumnRenamed("digest", "__digest"), "__digest", "left")
    return put_columns(out, n_bytes=F.col("__bytes"), n_tokens=F.col("__count"), over_limit=F.col("__count") > limit).drop("__digest", "__bytes", "__count")
