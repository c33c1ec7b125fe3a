"""Corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the last return
the columns of documents.

quality_rules: documents that fail the rules go.
jaccard_join: of each group of linked documents the one with the least id stays.
suffix_dedup: byte strings of 200 bytes that start at two places or more are cut from the texts.
secret_scan: spans of secrets are replaced by a mark.
packing: what is left becomes pieces of sequences of at most 4096 tokens.

Stages are called one after another, each on the written rows of the one before: what a stage wrote besides its rows is deleted when the next
one is called on other files, so a stage's frame has to be written before that.

Defined results, for every stage: a null text is like an empty one, and stays null where the row stays. quality_rules drops
texts without words; jaccard_join links them with nothing, so it keeps them all; suffix_dedup and secret_scan leave them
as they are; packing makes each a document of the end id alone. Rows that repeat one another are judged alike, one by one;
jaccard_join keeps one of them, that of the least row hash among equal ids; a null id comes after all others. Texts of any
length are worked on whole. An empty table gives no rows. All stages but the last return the columns that they were
given, in their order and types and whatever their names; n_chars follows where text is changed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import jaccard, packing, quality_rules, secrets, suffix_dedup
from ledgerline.llm.shared import Workspace, gathered, sweep


#: Workspaces of the stage that was called last.
_LAST: list[Workspace] = []


def tidied(stage: Callable) -> Callable:
    """The stage, after deleting what the one before it wrote besides its rows: those have been written and read again by now.

    A workspace that the rows still come from stays.
    """

    def run_tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _LAST else []
        for space in _LAST:
            if not any(space.root.rpartition("/")[2] in file for file in read):
                space.close()
        _LAST.clear()
        sweep(spark)
        with gathered() as spaces:
            out = stage(spark, docs, sf_dir)
        _LAST.extend(spaces)
        return out

    return run_tidied


@tidied
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_quality(docs, public_tokenizers.path("piece_bpe_32k.model"))


@tidied
def join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(spark, docs)


@tidied
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(spark, docs)


@tidied
def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spark, docs)


@tidied
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("jaccard_join", join), ("suffix_dedup", dedup), ("secret_scan", scan), ("packing", pack)]
#: Tokenising, repeated strings and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each one's rows written to the shared folder and read by the next.

    What a stage wrote besides goes when its rows are written, and its predecessor's rows with it.
    """
    space, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    for left in _LAST:
        left.close()
    _LAST.clear()
    return docs
