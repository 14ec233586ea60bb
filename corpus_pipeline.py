"""The corpus pipeline: quality, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last keep the
columns of `documents`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import hyperminhash, mixing, packing, quality
from footfall.llm.common import Workspace, raw_texts, table

THRESHOLD = 0.3
# Near duplicates share 0.8 of their shingles of 5 words. A pair at 0.8 shares none
# of the 25 bands with probability (1 - 0.8**5)**25, about 5e-5.
NEAR = hyperminhash.Settings(width=5, percent=80)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))

    def accept(batches):
        for batch in batches:
            scores = model.score(quality.feature_matrix(raw_texts(batch)))
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(accept, docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    Of rows that share the id that stays, the first as JSON stays. Rows
    without an id all stay.
    """
    gone = (
        hyperminhash.near_duplicates(docs, NEAR).filter("NOT kept").select("doc_id").distinct()
    )
    work = Workspace(spark, "kept-documents")
    stay = work.stage(docs.join(gone, "doc_id", "left_anti").select(docs.columns), "stay")
    repeated = stay.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.take(1):
        return stay
    # The first by its values, written as JSON, is folded in the map tasks, however
    # often an id repeats.
    row = F.struct(*[F.col(f"`{c}`") for c in stay.columns])
    first = (
        stay.join(repeated, "doc_id", "left_semi")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min_by(row, F.to_json(row)).alias("row"))
        .select("row.*")
    )
    return stay.join(repeated, "doc_id", "left_anti").select(stay.columns).unionByName(first)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

# A trained classifier and a tokenizer decide rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next begins."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = work.stage(stage(spark, docs, sf_dir), name)
        if number:
            work.drop(STAGES[number - 1][0])
    return docs
