"""A pipeline that makes training data of raw documents, stage by stage.

Toxic documents go; of each group of near-duplicates the document with the
smallest doc_id stays; documents that hold benchmark passages go; secrets are
replaced in the texts; and the texts are encoded, with a check that they decode.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, decontam, secret_scan, simhash, toxicity
from lectern.llm.common import shared_folder, table
from lectern.llm.entry import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field does not reject.

    Null and empty texts are judged as the field judges no tokens; without labels
    of both classes every score is the share of toxic labels. Repeated rows go or
    stay together; an empty table gives none; other columns are kept whatever
    their names.
    """
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, nulls last.

    Null, empty and wordless texts are near-duplicates of each other. Ties go to
    the smallest hash of the text, then of the other columns; of equal rows one
    stays. An empty table gives none; other columns are kept.
    """
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs.

    Null and empty texts have no words and stay; so does everything if the
    benchmark is empty. Repeated rows go or stay together; other columns are kept.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; the grammars are learned from the documents given.

    Null and empty texts stay as they are; repeated rows stay equal; no row goes;
    other columns are kept.
    """
    return secret_scan.redact(docs, secret_scan.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number, and whether they decode to the text.

    A null text counts as empty and has no ids. Columns named n_tokens, token_ids
    and round_trip are replaced; all others are kept; no row goes.
    """
    return bpe.with_tokens(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe_encode", encode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``.

    Each result is written to the shared folder and read again, and goes when the
    next is written; the last one's input stays until the session's owner removes it.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        own = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if before is not None:
            _remove(spark, before)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
