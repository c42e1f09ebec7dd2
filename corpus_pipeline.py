"""The corpus pipeline: five of the operators, one after the other, over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``docs``; rows with a null id or text pass every filter
that has no evidence against them (a repeat of another row is evidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.llm import line_dedup, minhash, sentencepiece, toxicity, winnowing
from workboard.llm.common import free_name, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any severity is a half or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(~F.col("toxic")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three-line windows go; a document of which nothing is left goes too.

    ``n_chars`` follows the text.
    """
    cut = line_dedup.dedup_lines(docs)
    kept = cut.filter(F.col("n_removed").isNull() | (F.col("n_removed") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: that with the smallest id.

    A document is an id with a text, named by a 64-bit hash of both, so different texts
    under one id are different documents, and rows without an id take part like others
    (one with an id stays before them). Of rows that repeat id and text one stays.
    """
    key = free_name(docs, "key")
    named = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = stored(minhash.near_duplicates(named.select(key, "text"), id_col=key, words=5)
                    .select(F.col("id").alias(key), F.col("component_id").alias("c")), "near-groups")
    # Only rows that are not alone in their group go on: ids and hashes, no texts.
    several = stored(groups.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c"), "near-several")
    crowd = stored(groups.join(several, "c").groupBy(key, "c").agg(F.count(F.lit(1)).alias("n")), "near-crowd")
    first = (named.select("doc_id", key).join(crowd, key).groupBy("c")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key))[key].alias(key)))
    first = stored(first, "near-first")
    gone = crowd.join(first, key, "left_anti").select(key)
    twice = crowd.filter("n > 1").join(first, key, "left_semi").select(key)
    alone = named.join(stored(gone.unionByName(twice), "near-gone"), key, "left_anti").select(*docs.columns)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    once = named.join(twice, key).groupBy(key).agg(F.min_by(whole, F.xxhash64(whole)).alias("row")).select("row.*")
    return alone.unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in benchmark windows go."""
    found = winnowing.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and the text that these decode to."""
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Two stages (a trained classifier, a BPE encoder) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
