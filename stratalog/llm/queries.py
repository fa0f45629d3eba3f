"""Registered queries of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path
from . import ann, archive, clusters, decontaminate, licenses, mixing, neardup, quality, ranked, repeats, shards, token_files, toxicity
from .common import table
from .oracles import ORACLES  # noqa: F401


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates by 2-word shingles."""
    return neardup.near_duplicates(table(spark, folder, "documents"), words=2)


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices."""
    return licenses.license_report(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in documents."""
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_key")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages stored by digest, written to WARC files from there and read back."""
    path = scratch_path(spark, "archive")
    archive.write_archive(table(spark, folder, "pages"), path)
    archive.write_warc(spark, path, f"{path}/warc")
    return archive.page_report(spark, f"{path}/warc")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mixing.mix_sizes(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated paragraphs, lines of any length and sentences to remove."""
    return repeats.repeated_units(table(spark, folder, "documents"), least_line=1).drop("text_key")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    placed = shards.assign_shards(table(spark, folder, "documents"))
    return placed.withColumn("law", F.lit("key"))


def op10_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest found for every hundredth vector."""
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after 5 rounds with 40 centroids."""
    return clusters.cluster_vectors(table(spark, folder, "embeddings"))


def op12_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item, on an index of all documents."""
    index = ranked.build_index(table(spark, folder, "documents"))
    return ranked.search(spark, index, table(spark, folder, "benchmark"))


def op13_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written as compressed shards and read back."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path, ids=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_licenses, op3_toxicity, op4_decontaminate, op5_quality,
        op6_warc, op7_mixing, op8_repeats, op9_sharding, op10_ann,
        op11_clusters, op12_ranked, op13_tokens,
    )
}
