"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Stages filter whole documents, rewrite texts (pseudonyms) and at last cut them into pieces. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conforma.llm import decontaminate, jaccard, langid, packing, pii
from conforma.llm.common import Scratch, id_remainder, shared_root, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognised language go."""
    learned = langid.learn(docs.filter(id_remainder(4) != 2).select("text", "lang"))
    found = langid.identify(docs, learned)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Of rows of one id the least one by its columns' values stays; rows without an id stay all.
    """
    scratch = Scratch(spark, "near-duplicates")
    groups = jaccard.link(docs)
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    stay = scratch.write(stay, "stay")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = scratch.write(repeated.select("doc_id"), "repeated")
    named = docs.join(jaccard.small(stay), "doc_id", "left_semi")
    once = named.join(jaccard.small(repeated), "doc_id", "left_anti")
    again = named.join(jaccard.small(repeated), "doc_id", "left_semi")
    again = again.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    rest = docs.filter(F.col("doc_id").isNull())
    return once.unionByName(again).unionByName(rest).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a twentieth or more of test phrases makes up go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).filter(~F.col("contaminated")).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms; n_chars follows."""
    found = pii.pseudonymise(docs)
    n = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
    kind = docs.schema["n_chars"].dataType
    return found.withColumn("n_chars", n.cast(kind)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("pseudonyms", pseudonyms),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; stages are written into the shared folder."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
