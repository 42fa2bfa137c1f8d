"""Registered queries of the package: every operator over its whole table with
production parameters. Digest columns are derived here from the operators'
own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens.llm import (
    exact, html_text, langid, merkle, near, packing, pieces, pii, resampling, rules, secret_scan,
    spelling, suffixes)
from surveylens.llm.common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of at most 1024 tokens, packed by sum of squares."""
    return packing.pack_documents(documents(spark, sf_dir), added_tokens=True)


def _span_columns(spans, kinds: tuple[str, ...]) -> dict:
    """Counts of base spans by kind, and the digest and list of spans, from an
    ``array<struct<start,end,kind,base>>`` column."""
    def said(chosen):
        return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter(spans, lambda x: x["base"])
    of_base = F.transform(base, lambda x: x["kind"])
    counts = {f"n_{kind}": (F.size(of_base) - F.size(F.array_remove(of_base, kind))).cast("long") for kind in kinds}
    return counts | {"base_sha256": F.sha2(said(base).cast("binary"), 256), "spans": said(spans)}


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: pattern spans and those that the field adds."""
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *(c.alias(n) for n, c in _span_columns(found.spans, pii.KINDS).items()))


def op3_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: the number and check sum of
    its ids, and whether the text came back."""
    return pieces.encode_and_back(documents(spark, sf_dir)).select(
        "doc_id", "n_ids", "ids_crc32", "text_crc32", (F.col("text_crc32") == F.col("decoded_crc32")).alias("round_trip"))


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies: a Jaccard similarity of 0.85 or more on five-word shingles."""
    return near.near_groups(documents(spark, sf_dir), threshold=0.85)


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the row with the largest id stays."""
    return exact.mark_copies(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_secret_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: pattern spans and those that the network adds."""
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *(c.alias(n) for n, c in _span_columns(found.spans, secret_scan.KINDS).items()))


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, repetition coverage and verdict of every document."""
    return rules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_max("dup_ngram_share").alias("dup_ngram_share"), "dup_line_share")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and Gumbel top-k decision of every document."""
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return langid.identify(documents(spark, sf_dir))


def op11_prefix_suffix_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their near words, forms and roots."""
    return spelling.variants(documents(spark, sf_dir))


def op12_external_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the documents that 200-byte repeats cover, and the digest of the others."""
    found = suffixes.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op13_sha_midstate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of the documents; a third of the ids, by their check sum, are
    checked with a text in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, merkle.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify(documents(spark, sf_dir), {"text": text}).drop("pos")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii_skip_chain": op2_pii_skip_chain,
    "op3_sentencepiece_viterbi": op3_sentencepiece_viterbi,
    "op4_hyperminhash": op4_hyperminhash,
    "op5_site_style_tree": op5_site_style_tree,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_convnet": op7_secret_convnet,
    "op8_repetition_rules": op8_repetition_rules,
    "op9_importance_resampling": op9_importance_resampling,
    "op10_language_crf": op10_language_crf,
    "op11_prefix_suffix_tiling": op11_prefix_suffix_tiling,
    "op12_external_induced_sorting": op12_external_induced_sorting,
    "op13_sha_midstate_tree": op13_sha_midstate_tree,
}

#: DuckDB SQL of the queries that SQL can state.
ORACLE_SQL = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
