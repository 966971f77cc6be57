"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and
reads it again as the next one's documents. All stages but the last return the columns of the documents.

* language: the model learns from all labelled rows of its input; rows that it rejects go (no letter, or too far from
  each centroid).
* lines: lines on ``line_dedup.MIN_SITES`` sources or more are taken out of the texts, and ``n_chars`` follows; rows stay.
  Lines that are on so many sources only by copies or near copies of whole documents stay, for the next stage to judge.
* near duplicates: of documents linked by sets of 5-word shingles similar by 0.8 or more, that with the smallest id stays.
* benchmark: documents that hold a window of a benchmark item go.
* pieces: ``ids`` of the pieces of each text, and whether they decode to it.

No stage has SQL for its decisions on the whole: ORACLE_SQL is None, and the tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import common, decontamination, jaccard_join, language_id, line_dedup, sentence_pieces

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known well enough."""
    model = language_id.fit(docs)
    renamed = docs.select(*[F.col(c).alias(f"_own_{c}") for c in docs.columns])  # no result column can clash
    kept = language_id.identify(renamed, model, "_own_text").where(~F.col("rejected"))
    return kept.select(*[F.col(f"_own_{c}").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without boilerplate lines."""
    renamed = docs.select(*[F.col(c).alias(f"_own_{c}") for c in docs.columns])
    cleaned = line_dedup.remove_boilerplate(renamed, "_own_text", "_own_source", copies_apart=True)
    shorter = F.when(F.col("n_removed") > 0, F.length("_own_text").cast("long"))
    return cleaned.select(*[(F.coalesce(shorter, F.col("_own_n_chars")) if c == "n_chars" else F.col(f"_own_{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="documents")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and whether they decode to it."""
    found = sentence_pieces.encode_and_decode(docs.select("doc_id", "text"), PIECE_BPE)
    same = F.col("decoded").eqNullSafe(F.regexp_replace("text", sentence_pieces.MARK, " "))
    return found.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [("language", language), ("lines", lines), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
