"""Corpus preparation in stages; each calls an operator of ``driftline.llm``.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes to the shared folder and reads again for the
next one. Stages keep all columns of the documents but the last, whose rows are pieces of packed sequences.

- toxicity: documents of score 0.3 or more go; the lexicon is learned from labelled rows outside the held-out fold.
- near_duplicates: one document of each class stays, that of the smallest id; texts of five-word Jaccard similarity 0.8 or more,
  verified on the texts, and close fingerprints make a class.
- decontamination: documents that hold a benchmark item go.
- personal_data: spans of personal data in the text are replaced by their kind; no document goes.
- packing: ids of what is left, packed into sequences of 4096 tokens.

Nulls, empty texts, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, nearcopies, packing, pii, toxicity
from driftline.llm.common import free_name, stored
from driftline.llm.queries import table, tokenizer_file, toxicity_model

ORACLE_SQL = None  # fingerprints, tokenizers and learned models have no SQL; tests compare with brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, docs, sf_dir)
    name = free_name(docs, "toxic")
    return docs.withColumn(name, toxicity.scored(docs, model)).filter(F.col(name)["score"] < 0.3).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json")).drop("cost")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if at < len(STAGES) else docs
    return docs
