"""From raw documents to packed token sequences, in stages that each hand on a table.

Documents of low quality go, then toxic ones, then near copies of a kept one;
what is left is packed. Each stage takes the documents that its predecessor
kept and, but for the last, returns them with their columns, whatever these are
called besides doc_id and text.

Null and empty texts are scored like others and are near copies of each other;
very long texts are read whole. Rows are decided on one by one: rows with a null
id pass all filters on ids, repeated rows are near copies, and of rows that
share an id each different text stands for itself. Of equally near copies the
one with the least id stays. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import near_duplicates, packing, quality, toxicity
from millrace.llm.common import discard, free_name, shared_path, table

CAPACITY = 4096
END_ID = 1


def decided(module, label: int, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier, learnt from those of ``docs`` with a label, gives ``label``."""
    model = module.fit(docs, table(spark, sf_dir, "labels"))
    names = tuple(free_name(n, docs.columns) for n in ("held_out", "score", "predicted"))
    scored = module.score(docs, model, keep=docs.columns, names=names)
    return scored.filter(F.col(names[2]) == label).drop(*names)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decided(quality, 1, spark, docs, sf_dir)


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decided(toxicity, 0, spark, docs, sf_dir)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)


STAGES = [
    ("quality_classifier", good_documents),
    ("toxicity", civil_documents),
    ("near_duplicates", distinct_documents),
    ("packing", packed_sequences),
]

#: Learnt scores and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. A stage's table is removed once the next one is written; the last stage reads the one that is left."""
    docs = table(spark, sf_dir, "documents")
    written = None
    for name, stage in STAGES[:-1]:
        out = shared_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if written:
            discard(spark, written)
        written = out
    return STAGES[-1][1](spark, docs, sf_dir)
