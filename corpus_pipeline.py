"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Stages are cut at stored tables, so a lost executor repeats no earlier stage.

Defined results, for every stage: columns beyond those of documents are carried along, whatever their names; a null id
is an id of its own kind that comes last; an empty table gives an empty table. Null and empty texts go in the first
stage; of repeated rows the second keeps one. The stages treat nulls, long texts and ties as their operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglake.llm import language_id, mixing, packing, simhash_neardup, substring_dedup
from dialoglake.llm.common import freeze, read

TOKENIZER = "word_bpe_49k.json"
#: Shares of expected tokens: almost all from clean documents.
MIX = {"clean": 0.96, "low": 0.03, "toxic": 0.01}

#: Language ID, SimHash, soft mixing and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is ambiguous; the model is fitted on the
    language column of the documents outside the held-out fifth."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest
    doc_id. Of repeated rows of that document one stays; a null id is kept only if its group has no other."""
    return simhash_neardup.keep_one_copy(docs, shingle_words=5, similarity=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a document that nothing is left of goes. n_chars follows the text."""
    kept = substring_dedup.remove_repeats(docs, drop_emptied=True)
    return kept.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by the rates that give MIX its expected tokens; the budget is such that clean
    documents keep a rate of just over 1."""
    return mixing.resample(docs, mixing.domains_of_labels(read(spark, sf_dir, "labels")), MIX, anchor="clean", anchor_rate=1.02)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity=2048)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
