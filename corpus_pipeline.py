"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents. All stages but the last return the columns of `documents`.

A null doc_id is no reason to reject a row; null texts have no words and fall to the first stage. Of repeated
rows one stays; among near duplicates rows with a doc_id go before rows without. A doc_id names one text: where
it names several, all its rows share the fate of one of them. An empty table, before or after any stage, gives an
empty result; without labels that meet a text nothing is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import jaccard_join, packing, quality_rules, toxicity
from marlstone.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = jaccard_join.Near(5, 80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the policy keeps. The ledger, stored beside the rows, holds the rejected ones too."""
    return quality_rules.filtered(docs.select(COLUMNS), quality_rules.POLICIES["2"])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores below one half; trained on the labelled rows that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.below(docs.select(COLUMNS), model, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group: five-word shingles, similarity 0.8 or more.

    Rows without doc_id take part under a number made from their text, above all ids that are below 2^62.
    """
    number = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND((1 << 62) - 1) + (1 << 62))
    keyed = docs.select(*COLUMNS, number.alias("_k"))
    others = jaccard_join.linked(keyed.selectExpr("_k AS doc_id", "text"), NEAR).where("component_id != doc_id").selectExpr("doc_id AS _k")
    return keyed.join(others, "_k", "left_anti").dropDuplicates(["_k", "text"]).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("jaccard_join", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else stored(out, name)[0]
    return docs


#: Classifier and packing have no SQL form. tests/llm/test_pipeline.py compares each stage with a brute-force version, one after another.
ORACLE_SQL = None
