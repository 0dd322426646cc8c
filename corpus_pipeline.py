"""A corpus from raw documents to pieces: each stage reads what the one before it kept, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm._store import materialise
from lacuna.llm.decontaminate import uncontaminated
from lacuna.llm.jaccard_join import one_of_each
from lacuna.llm.language import in_known_languages, train_languages
from lacuna.llm.pieces import encode_pieces
from lacuna.llm.queries import KEY, N_BEST, PERCENT, WINDOW, table, tokenizer
from lacuna.llm.surrogates import replace_entities

#: Mean probability of the language found, below which a document is rejected as of no known language.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay: those without a letter, or on which the network decides nothing, go."""
    return in_known_languages(docs, train_languages(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays, once, whatever its id; texts without words stay."""
    return one_of_each(docs, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars follows the new text."""
    count = "n_replaced"
    while count in map(str.lower, docs.columns):
        count += "_"
    done = replace_entities(docs, KEY, count_col=count)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.drop(count)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces, with the ids and scores of the best segmentations and whether decoding gives the text back."""
    done = encode_pieces(docs, tokenizer("piece_bpe_32k.model"), N_BEST, keep=("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "lang", "source", "text", "piece_ids", "n_pieces", "nbest_ids", "nbest_scores", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("privacy", privacy), ("pieces", pieces)]

#: A network, keyed surrogates and lattices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
