"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. quality: documents that the calibrated classifier rejects go;
2. near_dedup: one document of each group of near-duplicates (five-word shingles, 0.8) stays;
3. repeats: byte strings of 400 that occur twice among the rest are cut out;
4. mixture: documents are drawn with the probabilities of a raked mixture;
5. pieces: texts are encoded with the piece vocabulary; the ids come with digests of ids and decoded text.

Rows with a NULL id are scored, cut, drawn and encoded like others but belong to no group. All
columns of the input, also ones beyond ``documents``, are carried through.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import twinframe
from twinframe.llm.common import cut_lineage, table
from twinframe.llm.minhash_links import near_duplicates
from twinframe.llm.mixing import mixed_documents
from twinframe.llm.piece_tokens import with_pieces
from twinframe.llm.quality import keep_quality
from twinframe.llm.queries import MIXTURE, PIECE_MODEL
from twinframe.llm.suffix_dedup import without_repeats

# executors need no installed copy of the package
cloudpickle.register_pickle_by_value(twinframe)

SHINGLE, PERCENT = 5, 80
REPEAT_BYTES = 400
BUDGET = 0.95  # share of the tokens that the mixture may keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows that repeat a kept id and its text, one."""
    found = cut_lineage(near_duplicates(docs, shingle=SHINGLE, percent=PERCENT).where("doc_id IS NOT NULL"))
    gone = cut_lineage(found.where("NOT kept").select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = cut_lineage(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = left.join(repeated, "doc_id", "left_anti")
    return once.unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).toDF(*left.columns).select(*[f"`{c}`" for c in docs.columns])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings that occur elsewhere in the rest."""
    return without_repeats(docs, length=REPEAT_BYTES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mixture."""
    return mixed_documents(docs, MIXTURE, BUDGET)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids."""
    return with_pieces(docs, PIECE_MODEL, keep_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("mixture", mixture), ("pieces", pieces)]

# no SQL: the classifier and the merge agenda have none; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
