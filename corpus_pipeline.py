"""A corpus pipeline of five stages: documents in, token blocks' index out.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. The stages' outputs are written as Parquet and read back between them.

Columns pass through whatever their names, and very long texts are treated whole. An empty table stays empty at every
stage. What nulls, empty texts, ties and repeated rows come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrest.llm import _common, decontaminate, minhash, mixing, quality_rules, token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that the base rule fails (null, empty and short texts among them) and those that the learned list rejects. Repeated rows and ids are judged each by its own text; without labels only the base rule rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, name, _ = quality_rules.quality_rules(docs, labels)
    return judged.where(F.col(f"{name}.kept")).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least id: shingles of five words, a similarity of 0.8 or more. Texts without words and rows of null id are in no group and stay; an id's rows stay or go together."""
    return minhash.deduplicated(docs, width=5, threshold_percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, each row by its own text. Texts without words stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes the block where they begin, so some leave and some come up to three times. Texts without words stay once; a null source is a source; equal rows share what their blocks get."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token blocks' documents, read back: doc_id, start, n_tokens, ids_crc32. A text without words is its own few ids and the end; null ids come first; repeated rows are written each."""
    return token_output.token_index(_common.materialize(token_output.encode_documents(docs), "none"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
    ("token_output", tokens),
]

#: Learned rules, near-duplicate groups, string tiling and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = _common.materialize(docs)
    return docs
