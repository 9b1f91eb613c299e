"""Every operator of this subpackage under the name that the driver runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm import (
    binary_records,
    components,
    licenses,
    near_duplicates,
    packing,
    positional_index,
    prefix_trie,
    quality_rules,
    sharding,
    shared,
    site_quality,
    tokens,
    toxicity,
    url_rules,
    vector_packing,
    whitening,
    word_tokens,
)

# Python workers need no copy of the package.
for module in (
    binary_records,
    components,
    near_duplicates,
    packing,
    prefix_trie,
    shared,
    site_quality,
    tokens,
    toxicity,
    vector_packing,
    whitening,
    word_tokens,
):
    cloudpickle.register_pickle_by_value(module)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates.duplicate_classes(documents(spark, sf_dir))
    return classes.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("representative"))


#: Production parameters of placement.
SHARDS = tuple(f"shard-{k:03d}" for k in range(256))


def op2_permutation_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir), SHARDS).select("row.doc_id", "slot", "shard")


def op3_weakly_supervised_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.verdicts(pages, url_rules.rule_table(pages, url_rules.RULES))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = binary_records.encode_to_records(documents(spark, sf_dir), tokenizer_file(), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_rules.quality_report(documents(spark, sf_dir))
    return report.withColumn("broken_rules", F.array_join("broken_rules", ","))


def op7_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.licence_report(documents(spark, sf_dir)))


def op8_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placement(packing.packed(documents(spark, sf_dir), tokenizer_file(), separator_id=0))


def op9_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, and the items with proximity matches."""
    report = positional_index.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return positional_index.digest(report, "near_items")


def op9_exact_and_proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier name of the whole operator."""
    return op9_positional_index_decontamination(spark, sf_dir)


def near_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's proximity matches: documents with most words of an item's window near their places."""
    report = positional_index.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    found = report.filter(F.size("near_items") > 0)
    return found.select("doc_id", F.array_join("near_items", ",").alias("near_items"), (F.col("n_hit") > 0).alias("exact"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(*whitening.whitened(table(spark, sf_dir, "embeddings")))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("key")


def op13_vector_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.best_fit_packed(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1, with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bagminhash_near_duplicates,
        op2_permutation_table_sharding,
        op3_weakly_supervised_toxicity,
        op4_redirect_equivalence,
        op5_token_records,
        op6_quality_rules,
        op7_licence_sentences,
        op8_tiered_packing,
        op9_positional_index_decontamination,
        op9_exact_and_proximity_matches,
        near_benchmark_passages,
        op10_site_quality,
        op11_embedding_whitening,
        op12_conversation_prefix_trie,
        op13_vector_best_fit_packing,
        pipeline,
    )
    return {query.__name__: query for query in found}
