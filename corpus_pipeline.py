"""A training corpus from `documents`: language, near-duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`,
with n_chars as it is after the stage. A stage's result is written as Parquet and reread as the next one's input. Other
columns, whatever their names, are carried along. Markup, licences, media and search have no stage here: `documents`
holds plain texts, and those operators select or add nothing that a packed sequence keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolith.llm import langid, minhash, packing, pii, suffix
from protolith.llm.common import carry, forget, materialize, session, table, uncarry

#: No SQL expresses the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    out = uncarry(out, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: list[str] | None = None, least: float = langid.LEAST_SCORE) -> DataFrame:
    """Documents of another language than `languages` (None: the learned ones), or of a lower score than `least`, go.

    So do documents without a letter. A null lang becomes the language found. Without labels only the latter go.
    """
    session(spark)
    return langid.accepted(docs, langid.model_of(docs), languages, least)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least doc_id. Links are at 0.8 on shingles of five words.

    Of several texts of one doc_id each is a document of its own: one that is alike to another document's goes. Of rows
    that repeat a doc_id and its text one stays. Rows without doc_id are told apart by nothing and stay.
    """
    session(spark)
    kept = minhash.group(docs, width=5, level=80, hashed=True).filter("kept").groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    kept = materialize(kept)
    th = F.xxhash64(docs["text"])
    same = lambda few: (docs["doc_id"].cast("long") == few["doc_id"]) & (th == few["th"])
    many = kept.filter("n > 1")
    if many.isEmpty():
        out = docs.join(kept, same(kept), "left_semi")
    else:
        one = kept.filter("n = 1")
        out = docs.join(one, same(one), "left_semi").union(docs.join(many, same(many), "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.union(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings that occur more than once go, the first occurrence too; a character cut in half reads as U+FFFD.

    Every document stays.
    """
    session(spark)
    out = suffix.remove_repeats(carry(docs), "carried")
    return _as(docs, out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each selected span becomes its kind in brackets."""
    session(spark)
    out = pii.detect(carry(docs), "carried")
    return _as(docs, out.withColumn("text", pii.redacted(F.col("text"), F.col("spans"))))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    session(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("suffix_dedup", repeated_passages), ("pii", personal_data), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
