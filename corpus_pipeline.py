"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import common, line_dedup, mixing, ngram_join, packing, quality

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("mixing sources", mixing.stage),
    ("packing", packing.stage),
]

#: Packing needs a tokenizer, which SQL has not; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; results between them lie in the shared folder of the session.

    Columns of documents go through all stages but the last, whatever their names; stages keep helpers under names of
    their own. Null and empty texts fail the quality rules. Rows that repeat are judged, taken and packed alike. A text of
    any length goes through whole. Without rows there are no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
