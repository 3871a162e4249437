"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelot.llm import alignment, bagminhash, hamming, langid, lines, packing, quality, runs, suffixes, token_files, toxicity, vectors, viterbi


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _fold(n: int):
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % n


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_copies(_table(spark, sf_dir, "documents")).drop("id")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), digest_only=True)


def op3_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"), differ=None)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), _fold(5) != 0)
    return toxicity.score(docs, model).withColumn("held_out", _fold(5) == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "between_blanks")
    return packing.pack(pieces)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn(docs, _fold(4) != 2)
    return langid.predict(docs, model).withColumn("held_out", _fold(4) == 2)


def op9_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.check_round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest_only=True)


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_planted_runs(_table(spark, sf_dir, "documents"))
    return runs.run_digest(runs.periodic_runs(docs))


QUERIES = {f.__name__: f for f in (op1_bagminhash, op2_suffix_array, op3_flat_graph, op4_fuzzy_lines, op5_toxicity, op6_quality_rules, op7_best_fit_packing, op8_language_id, op9_streaming_viterbi, op10_token_files, op11_token_alignment, op12_multi_index, op13_periodic_runs)}
SQL = {"op6_quality_rules": quality.SQL}
