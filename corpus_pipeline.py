"""The corpus pipeline: documents in, packed token sequences out.

Stages, each over all that its predecessor kept, written as Parquet and read back in between:

1. toxicity: documents that the ordinal model rejects go.
2. ngram_join: one document of each group of near copies stays, the one with the least id (word 5-grams, a
   Jaccard similarity of 0.8 or more).
3. decontamination: documents that hold a window of ten words of a benchmark item go.
4. pii: personal values become format-preserving pseudonyms.
5. packing: documents are cut and packed into sequences of 2048 tokens; each piece has its ids and its place in its
   sequence, and `packing.sequences` of these rows gives the sequences.

Stages 1 to 4 return the columns of documents, whatever they are; n_chars stays what it was, since pseudonyms keep
their format. Defined results: a null or empty text is neither toxic, a copy nor contaminated, and is packed as the end
id alone; repeated rows of a group's least id are one; an empty table of documents gives no rows; without labels of both
classes nothing is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from bagloom.llm import decontaminate, ngramjoin, packing, pii, tokens, toxicity
from bagloom.llm.common import shared_dir, table


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def ngram_join_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.representatives(docs, width=5, threshold=80)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(docs).select(*docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.vocabulary_path(), with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the model, the pseudonyms nor the tokenizer; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/bagloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
