"""A training corpus from raw documents: toxic texts, near copies and leaked test items go, personal data is masked, sources are mixed.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame with the columns of
``documents``; the last adds each document's place in the mix. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import staged, table
from tablemill.llm.decontamination import find_leaks
from tablemill.llm.minhash import near_duplicates
from tablemill.llm.mixing import mix
from tablemill.llm.pii import sanitise
from tablemill.llm.toxicity import labelled_rows, score_toxicity, train

TOXIC = 0.7  # score from which a document goes
SHINGLE, SIMILAR = 5, 80  # words of a shingle, per cent of shingles in common from which documents are near copies


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below TOXIC. The model is trained on the labels of documents that are there; without both
    kinds of labels nothing can be learned, and every document stays."""
    labelled = staged(labelled_rows(docs, table(spark, sf_dir, "labels")))
    if labelled.where("toxic in (0, 1)").select("toxic").distinct().count() < 2:
        return docs
    model = train(docs, labelled)
    return score_toxicity(docs, model, threshold=TOXIC).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of those with the group's smallest id, or of all where none has an id. Repeated rows are copies
    too. Texts without words have no copies and stay. Rows are told apart by id and a hash of all columns; equal rows are counted."""
    row = F.xxhash64(*[part for c in docs.columns for part in (F.col(c), F.col(c).isNull())])
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__row": row})
    found = near_duplicates(keyed, shingle=SHINGLE, percent=SIMILAR, row="__row").where("n_shingles > 0")
    counted = found.groupBy(F.col("doc_id").alias("id"), F.col("__row").alias("row")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    marked = staged(counted.where("not kept or n > 1"))
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__row") == F.col("row"))
    kept = keyed.join(marked, same, "left_anti")
    repeated = marked.where("kept")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["__id", "__row"]))
    return kept.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's question and answer."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced; n_chars follows the text. A null text stays null."""
    masked = sanitise(docs)
    text = F.when(F.col("text").isNotNull(), F.col("pii_text"))
    return masked.withColumns({"text": text, "n_chars": F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with mix_block, mix_slot and mix_offset: read by (mix_slot, mix_offset), sources keep to their target weights."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
]

ORACLE_SQL = None  # SQL cannot express the decoder, the search or the schedule; tests compare run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
