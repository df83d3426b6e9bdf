"""The corpus pipeline: toxic documents go, documents of unknown language go, one document of each
group of near copies stays, personal data is masked, and the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`. Models learn from the training rows of the operators' contracts only.

Edge cases: rows with a null id are in no group and stay; of rows that repeat id and text one
stays; null and empty texts have no language, so the language stage rejects them; an empty
table gives an empty result; further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import language, packing, pii, shingle_join, toxicity
from tabloom.llm.common import read
from tabloom.session import shared_folder, written_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id", 5, 0))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unsure(docs, language.fit(docs.filter(~toxicity.held_out("doc_id", 4, 2))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = shingle_join.near_duplicate_components(docs)
    heads = written_table(groups.filter("doc_id = component_id").groupBy("doc_id").count(), "kept")
    once = docs.join(heads.filter("count = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    kept = once.union(docs.filter("doc_id IS NULL"))
    again = heads.filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.union(docs.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", known_language), ("near_copies", drop_near_copies),
          ("personal_data", mask_personal_data), ("packing", pack)]

#: SQL expresses neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
