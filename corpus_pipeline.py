"""A training corpus from raw documents: language, near copies, repeated strings, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseries.llm.common import cut, join_checked, table
from sparkseries.llm.language import accepted, learn
from sparkseries.llm.mixing import mix_sources
from sparkseries.llm.neardup import near_duplicates
from sparkseries.llm.packing import pack_documents
from sparkseries.llm.suffix import WORDS, remove_repeats

CAPACITY, LEAST_SCORE = 2048, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without letters, and rows whose best language is less likely than not, go."""
    return accepted(docs, learn(docs), LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least doc_id stays, and of rows that share an id one."""
    found = cut(near_duplicates(docs).select("doc_id", "kept"))
    gone = cut(found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    left = join_checked(docs, gone, ["doc_id"], "left_anti")
    twice = cut(found.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("doc_id"))
    n = twice.count()
    if not n:
        return left
    numbered = join_checked(left, twice, ["doc_id"], "left_semi", rows=n).select(F.struct("*").alias("r"), F.row_number().over(Window.partitionBy("doc_id").orderBy(*docs.columns)).alias("rn"))
    return join_checked(left, twice, ["doc_id"], "left_anti", rows=n).unionByName(numbered.filter(F.col("rn") == 1).select("r.*"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur more than once are taken out of the texts, then passages of 50 words that occur more than once in what is left; every row stays."""
    left = cut(remove_repeats(docs))
    return remove_repeats(left, of=WORDS).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are read as often as their target weights ask, with as many tokens as came in."""
    return mix_sources(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences to train on."""
    return pack_documents(docs, CAPACITY)


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_strings", repeated_strings), ("source_mix", source_mix), ("packing", packed)]

#: SQL cannot express language identification; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
