"""Exact top-k by inner product over a vector-approximation file.

Vectors are integers floor(scale * x). The approximation file holds each distinct vector as one cell of 2**BITS a
dimension, a byte each, over the range that the dimension has in the whole table. A scan of the cells in blocks bounds
each inner product from both sides (cell middle, plus or minus the query's half-widths); a block reports what may be
among its best by these bounds, and what the bounds of all blocks rule out is dropped. Exact vectors are then read in
order of their bounds: first those of the best upper bounds, and then whatever the kth exact score doesn't rule out.

The queries' exact vectors and the cells are dealt by hash into blocks of bounded size, and every query block meets
every block of cells once: a stated query set against all rows. Exact vectors stay where they are until they are read.
Equal vectors are one candidate with their k + 1 least ids, so a vector that is most of the table is scored once.

Vectors that are null, empty, or hold null or non-finite components, and rows with null ids, take no part; nor do those
of which a component is 2**140 or more as an integer, which a float can't be. Integers are kept as doubles, which hold
them exactly. Where one of the table is too great for scores in longs, those pairs are scored in whole numbers of any
length, and ranked by them; a score that isn't a long is null then. Only vectors of a query's own dimension are compared
with it. A candidate is a row: a query meets every row but itself, so of rows that
repeat an id and its vector each is a query and finds the others. Ties go to the smaller vec_id. An empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

BITS, QUERY_BLOCK, VECTOR_BLOCK = 8, 1024, 8192


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: whole numbers floor(scale * x), as doubles; scale is a power of two, so nothing is rounded."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < 2.0**140) & ~F.isnan(c))
    whole = lambda y: F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)
    return vectors.filter(fine & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c.cast("double") * scale)).alias("v"))


def great(v: Column) -> Column:
    """Whether the vector may have scores that a long can't hold."""
    return F.exists(v, lambda x: F.abs(x) >= 2.0**31 / F.sqrt(F.size(v)))


LIMB = 62


def limbs(score: int) -> list[int]:
    """A whole number of up to 310 bits as five longs that are ordered as it is: the first has the sign."""
    return [score >> LIMB * 4, *[score >> LIMB * k & (1 << LIMB) - 1 for k in (3, 2, 1, 0)]]


def whole(told: Column) -> Column:
    """The long that limbs are, or null."""
    high = F.transform(F.slice(told, 1, 3), lambda x: F.when(x >= 1 << LIMB - 1, x - (1 << LIMB)).otherwise(x))
    sign, top, low = F.get(told, 0), F.get(told, 3), F.get(told, 4)
    # Bits 62 and up of a long are all its sign's.
    fits = F.forall(high, lambda x: x == sign) & (((sign == 0) & (top <= 1)) | ((sign == -1) & (top >= (1 << LIMB) - 2)))
    small = F.when(top == 0, low).when(top == (1 << LIMB) - 1, low - (1 << LIMB)).when(top == 1, low + (1 << LIMB)).otherwise(low - (1 << LIMB) - (1 << LIMB))
    return F.when(fits, small)


def rounded(told: Column) -> Column:
    """The double near limbs; those of a negative number are turned first, or they would cancel."""
    size = lambda of: sum((of(n).cast("double") * 2.0 ** (LIMB * (4 - n)) for n in range(5)), F.lit(0.0))
    limb = lambda n: F.get(told, n)
    return F.when(limb(0) < 0, -size(lambda n: F.lit((1 << LIMB) - 1 if n else -1) - limb(n))).otherwise(size(limb))


def approximations(classes: DataFrame) -> DataFrame:
    """The file: id, least, d (the dimension) and cells of distinct vectors (id, least, v), with the ranges that their cells divide."""
    each = classes.select(F.size("v").alias("d"), F.posexplode("v").alias("k", "x")).groupBy("d", "k").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ranges = each.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("k", "low", "high"))).alias("r")).select("d", F.col("r.low").alias("low"), F.col("r.high").alias("high"))

    def run(batches):
        for b in batches:
            cells = []
            for v, low, high in zip(b["v"], b["low"], b["high"], strict=True):
                lo, width = _cells_of(low, high)
                cells.append(np.minimum((np.asarray(v, np.float64) - lo) / width, 2**BITS - 1).astype(np.uint8).tobytes())
            yield pd.DataFrame({"id": b["id"], "least": b["least"], "d": b["d"], "low": b["low"], "high": b["high"], "cells": cells})

    # A row for each dimension there is: small by nature.
    return classes.withColumn("d", F.size("v")).join(ranges, "d").mapInPandas(run, "id long, least long, d int, low array<double>, high array<double>, cells binary")


def _cells_of(low, high) -> tuple[np.ndarray, np.ndarray]:
    lo = np.asarray(low, np.float64)
    return lo, np.maximum((np.asarray(high, np.float64) - lo) / 2.0**BITS, 1e-9)


def bounds(q: np.ndarray, cells: np.ndarray, lo: np.ndarray, width: np.ndarray, k: int):
    """(query, vector, upper bound) of each query's vectors that may be among its k best here, by their bounds."""
    middle = (cells + 0.5) * width + lo
    # A middle may be off by rounding, and an integer at the top of its range lies on the last cell's edge.
    half = width / 2 + np.abs(middle).max(axis=0, initial=0) * 1e-12
    for at in range(0, len(q), 128):
        part = q[at : at + 128].astype(np.float64)
        near, slack = part @ middle.T, np.abs(part) @ half
        slack += 1e-9 * (np.abs(part) @ np.abs(middle).max(axis=0, initial=0) + 1)
        least = np.partition(near, -k, axis=1)[:, -k] if len(cells) > k else np.full(len(part), -np.inf)
        i, j = np.nonzero(near + 2 * slack[:, None] >= least[:, None])
        yield at + i, j, near[i, j] + slack[i], near[i, j] - slack[i]


def candidates(file: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, id, upper, lower: pairs of a query (id, v) and an approximation that the bounds of its block don't rule out."""
    n, m = file.count(), queries.count()
    vb, qb = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    left = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(vb - 1))).alias("vb"))
    right = file.select("*", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(vb)).cast("int").alias("vb"))

    def meet(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.empty(0, t) for c, t in (("q", np.int64), ("id", np.int64), ("upper", np.float64), ("lower", np.float64))})]
        dims = q["v"].map(len)
        for d, some in v.groupby("d"):
            asked = q[dims == d]
            if len(asked):
                lo, width = _cells_of(some["low"].iloc[0], some["high"].iloc[0])
                cells = np.frombuffer(b"".join(some["cells"]), np.uint8).reshape(len(some), d)
                zero = asked["v"].map(lambda w: not any(w))
                # A zero query scores 0 with all: the least ids are its best, and no bound could tell them.
                best = some.nsmallest(k, "least")["id"].to_numpy()
                for one in asked.loc[zero, "id"]:
                    out.append(pd.DataFrame({"q": np.full(len(best), one), "id": best, "upper": 0.0, "lower": 0.0}))
                asked = asked[~zero]
                for i, j, upper, lower in bounds(np.stack(asked["v"].to_numpy()), cells, lo, width, k) if len(asked) else ():
                    out.append(pd.DataFrame({"q": asked["id"].to_numpy()[i], "id": some["id"].to_numpy()[j], "upper": upper, "lower": lower}))
        return pd.concat(out)

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, "q long, id long, upper double, lower double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for vectors of whole numbers (vec_id, v: array<double>); queries are rows of vectors."""
    # Equal vectors are one class, named by its least id: of its rows only the k + 1 least ids can be an answer.
    rows = materialize(vectors.groupBy("v", "vec_id").agg(F.count("*").alias("n")))
    order = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    members = materialize(least.groupBy("v").agg(F.min("vec_id").alias("least"), F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("rows")).withColumn("id", F.xxhash64("v", "least")))
    asked = materialize(queries.groupBy("v", "vec_id").agg(F.count("*").alias("n")))
    which = materialize(members.select("id", "v").join(asked.select("v").distinct(), "v", "left_semi"))
    # One more than k, as the query itself may be among its best.
    found = materialize(candidates(materialize(approximations(members.select("id", "least", "v"))), which, k + 1))
    best = lambda c: Window.partitionBy("q").orderBy(F.desc(c), "id")
    floor = found.withColumn("at", F.row_number().over(best("lower"))).filter(F.col("at") == k + 1).select("q", F.col("lower").alias("floor"))
    open_ = found.join(floor, "q", "left").filter("floor is null or upper >= floor").select("q", "id", "upper")
    open_ = materialize(open_.withColumn("at", F.row_number().over(best("upper"))))

    long_enough = members.filter(great(F.col("v"))).isEmpty()

    def exact(batches):
        for b in batches:
            told = [limbs(sum(int(x) * int(y) for x, y in zip(v, w, strict=True))) for v, w in zip(b["v"], b["w"], strict=True)]
            yield pd.DataFrame({"q": b["q"], "id": b["id"], "score": told})

    def read(pairs):
        """Exact scores of pairs, in whole numbers: longs, or their limbs where one of the table is too great for that."""
        both = pairs.join(members.select("id", "v"), "id").join(which.select(F.col("id").alias("q"), F.col("v").alias("w")), "q")
        product = F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
        scored = both.select("q", "id", product.alias("score")) if long_enough else both.select("q", "id", "v", "w").mapInPandas(exact, "q long, id long, score array<long>")
        return scored.join(members.select("id", "rows"), "id").select("q", "rows", "score")

    first = materialize(read(open_.filter(F.col("at") <= 2 * (k + 1))))
    kth = first.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("at") == k + 1).select("q", F.col("score").alias("kth"))
    # As a double it is off by less than the bounds' own slack.
    value = F.col("kth").cast("double") if long_enough else rounded(F.col("kth"))
    rest = open_.filter(F.col("at") > 2 * (k + 1)).join(kth, "q").filter(F.col("upper") >= value).select("q", "id")
    scores = first.union(read(rest))
    # Each row of a class, as often as it is there, for each row of the query's class; the query's own row once less.
    told = scores.select("q", "score", F.explode("rows").alias("r")).select("q", "score", "r.vec_id", "r.n")
    told = told.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= k + 1)
    lists = told.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score", "n"))).alias("best"))
    who = asked.join(which, "v").select(F.col("id").alias("q"), F.col("vec_id").alias("query_id"), F.col("n").alias("copies"))
    own = lambda x: F.when(x["vec_id"] == F.col("query_id"), x["n"] - 1).otherwise(x["n"])
    each = F.flatten(F.transform("best", lambda x: F.array_repeat(F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")), F.least(own(x), F.lit(k)).cast("int"))))
    out = who.join(lists, "q").select("query_id", "copies", F.slice(each, 1, k).alias("best"))
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", F.col("b.score") if long_enough else whole(F.col("b.score")).alias("score"))


def op6_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integers(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.filter(F.col("vec_id") % 50 == 0))


#: Plain arithmetic on the same integers.
ORACLE_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
