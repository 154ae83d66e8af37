"""Corpus pipeline: five stages over `documents`, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Nulls, empty and repeated rows follow the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, line_dedup, mixing, ngram_join, quality
from ledgerloom.llm.common import materialize, table
from ledgerloom.llm.registry import tokenizer_path

#: Wanted totals of expected tokens by domain, against those present: toxic and low text leaves, the rest stays.
FACTORS = {"good": 1.0, "good_toxic": 0.0, "low": 0.5, "low_toxic": 0.0}
#: What a boilerplate line has besides ten sources: words, share of all sources, share of all documents.
LINES = {"least_words": 4, "site_share": 0.5, "doc_share": 0.005}


#: Words that a document needs. Short documents may be good ones: which of them stay is up to the later stages.
LEAST_WORDS = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, of any length but empty ones, without their failed lines."""
    return quality.clean(docs, least_words=LEAST_WORDS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of four words or more, on ten sources and half of all, and in 0.5 % of the documents, leave."""
    return line_dedup.drop_boilerplate(docs, least_sites=10, **LINES)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity of 0.8 or more."""
    return ngram_join.drop_near_duplicates(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains that FACTORS leaves at 1, once each; of the lowered ones those drawn by their fitted rates."""
    rows = materialize(mixing.posteriors(docs, table(spark, sf_dir, "labels")), "posteriors")
    return mixing.take_by_domain(rows, FACTORS)[0].select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the whole text, their number, and whether they decode to the text."""
    got = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), verify=True)
    return got.select("doc_id", "lang", "source", "n_tokens", "ids", "exact")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the fitted classifier and the byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
