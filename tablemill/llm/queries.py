"""Named queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.alignment import align_tokens, with_pair_counts
from tablemill.llm.ann import build_index, nearest, usable
from tablemill.llm.chunks import mark_repeats
from tablemill.llm.common import table
from tablemill.llm.decontamination import find_leaks
from tablemill.llm.htmltext import main_text
from tablemill.llm.minhash import near_duplicates
from tablemill.llm.mixing import mix
from tablemill.llm.pieces import codec, default_model, encode_pieces
from tablemill.llm.pii import KINDS, kind_count, sanitise, span_list
from tablemill.llm.tokens import count_tokens
from tablemill.llm.toxicity import held_out, labelled_rows, score_toxicity, train
from tablemill.llm.trie import prefix_trie, rebuilt, turn_digests
from tablemill.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(run):
    QUERIES[run.__name__] = run
    return run


@register
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = F.col("pii_base"), F.col("pii_spans")
    return found.select(
        "doc_id",
        *[kind_count(base, kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
        kind_count(spans, "term").alias("n_term"),
        F.sha2("pii_text", 256).alias("clean_sha256"),
    )


@register
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model, threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_chars")))

    def total(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")

    return marked.select(
        "doc_id", "n_chars", total("shared_spans").alias("shared_chars"), total("repeated_spans").alias("repeated_chars"),
        listed("shared_spans").alias("shared_spans"), listed("repeated_spans").alias("repeated_spans"),
    )


# The archives' index in SQL: what a capture says of its payload, whatever order it was written and merged in.
ORACLES["op5_warc_captures"] = """WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
 digests AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads),
 firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM digests WHERE payload_bytes >= 100 GROUP BY 1)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM digests LEFT JOIN firsts USING (payload_digest)"""


@register
def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows.where("id % 50 = 0"), build_index(rows), k=5)


@register
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@register
def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leak = F.explode("leaks").alias("leak")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", leak)
    return found.select("doc_id", "leak.item_id", "leak.score", F.col("leak.question").alias("question_overlap"), F.col("leak.answer").alias("answer_overlap"))


@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_digests(table(spark, sf_dir, "conversations"))))


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    counted = with_pair_counts(aligned.withColumn("groups_sha256", digest).drop("groups"), codec(default_model()).size)
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


@register
def op13_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("piece_text", 256).alias("decoded_sha256"))
