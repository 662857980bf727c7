"""A corpus pipeline of five operators: identify, deduplicate, decontaminate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents, in their order; extra
columns pass through them, whatever their names. An empty table stays empty in every stage, and texts of any
length are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, langid, mixing, tokenfile
from tidemark.llm.common import materialise, table
from tidemark.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or of an ambiguous language; learned from the labelled documents outside the test fold.

    Null, empty and letterless texts go; repeated rows and null ids are judged each.
    """
    return langid.keep_identified(docs, docs.where(~langid.held_out()))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Empty texts are linked with nothing and null ids stay; rows that repeat an id stay or go together.
    """
    return jaccard.keep_one_of_each(docs, shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark text or a paraphrase of one.

    Null texts and ids stay; rows that repeat an id go together. An empty benchmark drops nothing.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source up to its target: documents beyond it go, those of a source short of it repeat.

    A null source is one of its own, a null text counts no word, equal ids of one source are taken alike.
    """
    return mixing.apply_mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files; returns doc_id, start, n_tokens and ids_crc32 of each document, read back from them.

    Null ids come first; repeats of an id are documents each, beside each other.
    """
    return tokenfile.read_tokens(tokenfile.write_tokens(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
