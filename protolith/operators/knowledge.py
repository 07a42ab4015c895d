"""The knowledge base of mappings (source, target, table_id, confidence, hits), its statistics and its rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(mappings: DataFrame, order: str) -> DataFrame:
    """One row of each (source, table_id): hits add up, confidence is the greatest, target and order the first's."""
    return mappings.groupBy("source", "table_id").agg(F.min_by("target", order).alias("target"), F.max("confidence").alias("confidence"), F.sum("hits").alias("hits"), F.min(order).alias("first_seen"))


def band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def route(score: Column) -> Column:
    """What a workflow does next by its score."""
    return F.when(score > 0.9, "download").when(score > 0.7, "ask").otherwise("map")


def stats(mappings: DataFrame, by: str, confidence: str) -> DataFrame:
    c = F.col(confidence)
    return mappings.groupBy(by).agg(F.count("*").alias("total"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"))


def best_targets(found: DataFrame, target: str, order: list, most: int = 10) -> DataFrame:
    """The best row of each target, then the first `most` of these."""
    w = Window.partitionBy(target).orderBy(*order)
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(*order).limit(most)


def quality(fields: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Mapping quality of each group: weighted share of matched fields, and its level."""
    n = lambda k: F.count_if(F.col(kind) == k)
    out = fields.groupBy(*by).agg(n("exact").alias("exact_count"), n("semantic").alias("semantic_count"), n("alias").alias("alias_count"), (n("fuzzy") + n("semantic") + n("alias")).alias("fuzzy_count"), n("unmatched").alias("unmatched_count"), F.count("*").alias("total"))
    score = (F.col("exact_count") + 0.85 * F.col("semantic_count") + 0.8 * F.col("alias_count") + 0.7 * (F.col("fuzzy_count") - F.col("semantic_count") - F.col("alias_count"))) / F.col("total")
    return out.withColumn("score", F.round(score, 3)).withColumn("level", F.when(score > 0.9, "excellent").when(score > 0.7, "good").otherwise("poor"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def dashboard(tasks: DataFrame, order: list, ok: Column, recent: int = 10) -> DataFrame:
    """All tasks, and how many of the newest succeeded and failed."""
    new = tasks.orderBy(*order).limit(recent).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
    return tasks.agg(F.count("*").alias("total")).crossJoin(new)  # one row each


def searched(knowledge: DataFrame, word: str = "", table_id: str = "") -> DataFrame:
    """Mappings whose source or target holds a word, without regard to case, and those of one table; empty: all."""
    w = F.lit(word.lower())
    out = knowledge.filter(F.lower("source").contains(w) | F.lower("target").contains(w)) if word else knowledge
    return out.filter(F.col("table_id") == table_id) if table_id else out


def all_stats(mappings: DataFrame, by: str, confidence: str) -> DataFrame:
    """`stats` of each group and, under a null name, of all; groups without a name are told apart by `whole`."""
    c = F.col(confidence)
    told = mappings.rollup(by).agg(F.count("*").alias("total"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"), (F.grouping(by) == 1).alias("whole"))
    return told.select(by, "whole", "total", "high", "medium", "low")


def distinct_quality(groups: DataFrame, fields: DataFrame, by: list[str], field: str, kind: str) -> DataFrame:
    """`quality` over distinct fields of each group, the first kind by name of one that has several; `unknown` of a group without fields.

    A group is a row of `groups`, which has the columns of `by`.
    """
    once = fields.groupBy(*by, field).agg(F.min(kind).alias(kind))
    out = groups.select(*by).distinct().join(quality(once, by, kind), by, "left")
    counts = [c for c in out.columns if c.endswith("_count") or c == "total"]
    return out.withColumn("level", F.coalesce("level", F.lit("unknown"))).fillna(0, counts).fillna(0.0, ["score"])


def page_of(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of rows, each with `total`: how many rows there are on all pages."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, number, size).join(F.broadcast(total))  # one row
