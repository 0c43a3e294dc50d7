"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's docs.

A stage takes (spark, docs, sf_dir) and gives a DataFrame. All but the last give
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import decontam, langid, mix, neardup, shard
from tracelode.llm.common import Scratch, fresh, table

#: A text of this many letters is rejected if its best cosine is below the bound. Measured on held-out texts: of 5,400 learned ones of
#: 50 characters or more the least cosine is 0.126; of 6,300 texts of unlearned scripts, from 5 to 2,000 letters, 99.6 % are under 0.1
#: at any length, as chance says (0 with a deviation of 1 / sqrt(1024) to each prototype). Shorter learned texts go down to 0.041.
LEAST_LETTERS, LEAST_SCORE = 50, 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least_letters: int = LEAST_LETTERS, least_score: float = LEAST_SCORE) -> DataFrame:
    """Null texts and texts without letters go, and those of ``least_letters`` or more whose best cosine is under ``least_score``; shorter ones say too little to go.

    Null and repeated ids, equal rows and columns beside those of documents are
    kept as they are; an empty table gives an empty one, and nothing learned
    rejects every text.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    (name,) = fresh(docs, "p")
    scored = docs.withColumn(name, langid.predict(F.col("text"), model))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    poor = F.when(F.col(f"{name}.score") < least_score, letters >= least_letters).otherwise(False)
    return scored.where((F.col(f"{name}.lang_pred") != langid.UNKNOWN) & ~poor).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity of 0.8 or more. All others of a group go.

    A row is known by doc_id and text, so a null or repeated id joins nothing:
    of each group one row with its least doc_id (null is least) stays, and rows
    of other groups stay whatever their id. Rows without words are in no group;
    of those with equal doc_id and equal text, one stays. Other columns are those
    of the row that stays. An empty table gives an empty one.
    """
    rows = neardup.with_components(spark, docs).where("kept").select("doc_id", "mark", "root")
    kept = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark")
    kept = kept.unionByName(rows.where("root is null").select("doc_id", "mark")).distinct()
    keys = fresh(docs, "id", "no_id", "mark")

    def keyed(df: DataFrame, mark) -> list:
        return [F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]), mark.alias(keys[2])]

    # the join deals the texts by these keys, and equal rows are dropped where they then are
    marked = docs.select("*", *keyed(docs, neardup.text_mark()))
    return marked.join(kept.select(*keyed(kept, F.col("mark"))), keys).dropDuplicates(keys).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; a document is known by its text. Null and empty texts overlap with nothing."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mix.mix_documents(spark, docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 8 shards, with shard and slot."""
    return shard.shard_records(docs, 8)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("sharding", sharding),
]
#: The language and near-duplicate stages are not expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a table in the shared folder is written after each but the last."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
