"""One registered query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinframe.llm.bloom_lm import score_texts
from twinframe.llm.collision_search import nearest_neighbours
from twinframe.llm.common import table
from twinframe.llm.divergence import divergence_sql, source_divergence
from twinframe.llm.language import identify
from twinframe.llm.main_text import main_text
from twinframe.llm.minhash_links import near_duplicates
from twinframe.llm.mixing import mixed_sample, mixing_sql
from twinframe.llm.piece_tokens import with_pieces
from twinframe.llm.prefix_trie import prefix_trie, prefix_trie_sql
from twinframe.llm.quality import score_quality
from twinframe.llm.spot_signatures import fingerprints
from twinframe.llm.suffix_dedup import removed_repeats
from twinframe.llm.token_transducer import count_tokens

# the wanted mixture: sources flattened, languages by share, topics nearly as they are
MIXTURE = {"source": 0.8, "lang": {"en": 0.52, "de": 0.18, "fr": 0.17, "es": 0.13}, "topic": 0.9}
MIXTURE_BUDGET = 0.8  # of all tokens

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page; all pages with content markup teach the weights."""
    return main_text(table(spark, folder, "pages"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    return with_pieces(table(spark, folder, "documents"), PIECE_MODEL, keep=["doc_id"])


def op3_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness."""
    return fingerprints(table(spark, folder, "documents"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's probability in a mixture of source, language and topic, and whether it is sampled."""
    return mixed_sample(table(spark, folder, "documents"), MIXTURE, MIXTURE_BUDGET)


def op5_bloom_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log probability under the filter's model and the base model."""
    return score_texts(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A calibrated quality score of every document."""
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every page; all documents teach the texts, all pages the hosts."""
    return identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 400-byte strings that occur elsewhere."""
    return removed_repeats(table(spark, folder, "documents"), length=400)


def op9_collision_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest_neighbours(table(spark, folder, "embeddings"), k=10, every=100)


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share four fifths of their four-word shingles."""
    return near_duplicates(table(spark, folder, "documents"), shingle=4, percent=80)


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """The distances of all sources of a language, and the terms that set each off."""
    return source_divergence(table(spark, folder, "documents"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The token count of every document, and whether it is over 4096."""
    return count_tokens(table(spark, folder, "documents"), PIECE_MODEL, limit=4096, keep=["doc_id"])


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every different beginning of the rebuilt conversations."""
    return prefix_trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_spot_signatures": op3_spot_signatures,
    "op4_mixing": op4_mixing,
    "op5_bloom_lm": op5_bloom_lm,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_collision_search": op9_collision_search,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_divergence": op11_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op4_mixing": mixing_sql(MIXTURE, MIXTURE_BUDGET), "op11_divergence": divergence_sql(), "op13_prefix_trie": prefix_trie_sql()}
