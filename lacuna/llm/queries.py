"""The ten operators with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_turns, loss_text, read_turns
from .decontaminate import contamination
from .jaccard_join import jaccard_components
from .language import held_out, identify_languages, train_languages
from .neighbours import nearest
from .pieces import encode_pieces
from .sharding import shard_rows
from .surrogates import replace_entities
from .token_counts import token_counts
from .url_rules import filter_rule, host_rule, judge_urls

SHARD_BYTES = 1 << 20
TOKEN_LIMIT = 512
WINDOW = 10
PERCENT = 75
NEIGHBOURS = 5
N_BEST = 3
KEY = "lacuna surrogate key 1"
#: Host rules, longest first in each chain of nested rules.
HOST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words that mark pages of no use for training, and the filter lines made of each; {n} runs over ten numbers, {t} over domains.
WORDS = ("ad", "ads", "adserver", "banner", "casino", "click", "doubleclick", "download", "login", "pixel", "popup", "porn", "signup", "track", "tracker", "xxx")
SHAPES = ("||{w}.", "||{w}-", "-{w}.", "-{w}-", "^{w}^", "/{w}-", "-{w}^", "_{w}^", "/{w}_", "/{w}.", "||{w}{n}.", "/{w}{n}^", "||{w}{n}-*.{t}^", "||cdn{n}.{w}.{t}^", "/{w}/*/{n}.gif|", "@@||help.{t}/{w}{n}^")
DOMAINS = ("com", "net", "org", "info", "biz")


def filter_lines() -> list[str]:
    """The filter list of the query: each shape for each word, number and domain that it names."""
    made = (s.format(w=w, n=n, t=t) for s in SHAPES for w in WORDS for n in (range(10) if "{n}" in s else [""]) for t in (DOMAINS if "{t}" in s else [""]))
    return [*made, "|ftp://*/Private/$match-case"]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, train_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "labelled")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), PERCENT)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, NEIGHBOURS)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    turns = f"array(named_struct('role', 'user', 'content', '{hard}'), named_struct('role', 'assistant', 'content', '{hard}'))"
    extra = spark.sql(f"SELECT -1L AS conv_id, {turns} AS messages")  # another layout than that of the table
    done = format_turns(table(spark, sf_dir, "conversations"), extra)
    turns = read_turns(F.col("formatted"))
    done = done.select("conv_id", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_pieces(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), N_BEST, keep=("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("n_pieces").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        "nbest_ids",
        "nbest_scores",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), TOKEN_LIMIT)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(*r) for r in HOST_RULES] + [filter_rule(line) for line in filter_lines()]
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_jaccard_join, op4_nearest_neighbours, op5_chat_formatting, op6_decontamination, op7_sentencepiece, op8_token_counts, op9_url_filters, op10_pii)}
