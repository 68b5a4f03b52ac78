"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingospan.llm import (
    decontamination,
    fill_in_middle,
    fingerprint,
    language_id,
    license_scan,
    near_dedup,
    packing,
    quality,
    ranked_search,
    secret_scan,
    sentence_pieces,
    substring_dedup,
    toxicity,
)
from lingospan.llm.tables import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(documents(spark, sf_dir)))


ORACLES["op1_secret_scans"] = secret_scan.oracle()


@query
def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(documents(spark, sf_dir)))


ORACLES["op2_license_scans"] = license_scan.oracle()


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path())


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.without_repeats(documents(spark, sf_dir)))


@query
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(fingerprint.fingerprinted(documents(spark, sf_dir)))


def learnable_languages(docs: DataFrame) -> DataFrame:
    return docs.where(language_id.fold("doc_id", 4) != 2)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = language_id.fit(learnable_languages(docs))
    held_out = (language_id.fold("doc_id", 4) == 2).alias("held_out")
    return language_id.predicted(docs, machine).select("doc_id", held_out, "lang_pred", "score")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(language_id.fold("doc_id", 5) != 0))
    held_out = (F.col("doc_id").isNotNull() & (language_id.fold("doc_id", 5) == 0)).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.scored(docs, net).select("doc_id", held_out, "score", predicted, "n_windows")


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    known = labels.where(language_id.fold("doc_id", 5) != 0)
    path = F.concat_ws("/", "source", F.coalesce("lang", F.lit(quality.NO_SITE)))
    return quality.rated(docs, known, F.col("source"), path)


@query
def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    return sentence_pieces.digest(sentence_pieces.encoded(documents(spark, sf_dir), model), model)


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.restored(fill_in_middle.transformed(documents(spark, sf_dir))))


ORACLES["op12_fill_in_middle"] = fill_in_middle.oracle()


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.searched(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = ranked_search.oracle()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
