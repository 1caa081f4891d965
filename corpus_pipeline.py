"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as
Parquet in the shared folder and gives the next stage what it reads back, so a lost
executor never costs more than the stage at hand.

Defined cases, by stage: a null or empty text has no words, so the quality rules reject
it; a null doc_id, lang or source takes part like any other value; of repeated rows and
of copies one row stays, that with the smallest doc_id and, at a tie, the smallest hash
of its row; the mix may take a document in several epochs, and packing then packs it as
often; very long texts are judged and carried whole by every stage; columns beside those
of documents pass through whatever their names, up to the
mix; an empty table gives an empty table at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pingworks.llm import jaccard, mixing, packing, quality, toxicity
from pingworks.llm.shared import cut

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("mixing to target weights", mixing.stage),
    ("packing", packing.stage),
]

#: A trained classifier and tokenizer ids are beyond SQL; tests hold `run` against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
