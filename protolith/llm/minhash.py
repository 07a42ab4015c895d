"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Words are runs without ASCII white space, A-Z lower-cased; a document's set has its distinct shingles of `width` words
(all words as one shingle if there are fewer; no words, no shingles). Circulant MinHash uses two permutations of the
32-bit circle: sigma once on every shingle, then pi, shifted by k for coordinate k. `bands` bands of `rows`
coordinates make buckets; at similarity 0.85 a pair shares none with probability (1 - 0.85**4)**24 = 2e-8.

Documents of equal sets are one class from the start. Every class of a bucket is compared with the bucket's pivot (the
class that shares buckets with most others) on full sets, which links most of a large group without making its pairs.
What is left are pairs x, y of one pivot p but two components. With l = |p - x| and a = how many shingles of x are in
neither p nor any other class of p, the sets differ in a_x + a_y + |l_x - l_y| shingles at least; only pairs that this
bound allows are made, after classes that it allows with no other are gone, and verified on full sets. So no candidate
is lost, and no bucket is gathered: buckets and pivots are joined, and Spark splits large ones.

What is summed for a pivot is written before it is joined, so that the join's two sides are plain shuffles, of which
Spark splits those of hot pivots and labels.

Null and empty texts have no shingles and are linked with nothing. Rows of one doc_id with equal texts are in one
component; with different texts they are documents of their own, linked only if they are alike. A null doc_id takes no
part in linking and keeps a null component. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forget, materialize, table, tidy
from .hashing import mix, shingles

WIDTH, BANDS, ROWS = 3, 24, 4
#: Similarity of a link, in hundredths.
LEVEL = 85


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: sets x coordinates."""
    out = np.empty((len(sets), coordinates), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    sigma = mix(flat.copy()).astype(np.uint32)  # the first permutation, on the circle of 2**32 places
    h, t = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        np.add(sigma, np.uint32(k), out=h)  # the second permutation, shifted by k
        np.right_shift(h, np.uint32(15), out=t)
        np.bitwise_xor(h, t, out=h)
        np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
        np.right_shift(h, np.uint32(12), out=t)
        np.bitwise_xor(h, t, out=h)
        np.multiply(h, np.uint32(0x297A2D39), out=h)
        np.right_shift(h, np.uint32(15), out=t)
        np.bitwise_xor(h, t, out=h)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _sketch(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    def emit(ids, th, sets):
        full = [k for k, s in enumerate(sets) if len(s)]
        sig = signatures([sets[k] for k in full], bands * rows).astype(np.uint64)
        name = np.zeros((len(full), bands), np.uint64)
        for r in range(rows):
            name = mix(name * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows] + np.arange(bands, dtype=np.uint64) * np.uint64(r == 0))
        a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        for k in full:
            a[k] = mix(sets[k].copy()).sum()
            b[k] = mix(sets[k] ^ np.uint64(0x5851F42D4C957F2D)).sum()
        lists: list = [None] * len(sets)
        for k, row in zip(full, name.view(np.int64), strict=True):
            lists[k] = row
        return pa.RecordBatch.from_arrays([ids, th, pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        for batch in batches:
            ids, th, sets, first, size = batch.column(0).cast(pa.int64()), batch.column(2), [], 0, 0
            for k, s in shingles(batch.column(1).to_pylist(), width):
                sets.append(s)
                size += len(s)
                if size > 1 << 17:
                    yield emit(ids.slice(first, len(sets)), th.slice(first, len(sets)), sets)
                    sets, first, size = [], k + 1, 0
            if sets:
                yield emit(ids.slice(first, len(sets)), th.slice(first, len(sets)), sets)

    return run


def _sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [s.view(np.int64) for _, s in shingles(part.column(1).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes na and nb, and both sets."""
    x = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return pairs.join(x, "a").join(y, "b")


def alike(same: Column, level: int) -> Column:
    return 100 * same >= level * (F.col("na") + F.col("nb") - same)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each linked id reaches."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = materialize(both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        step = label.join(near, "id", "left").select("id", "component", F.least("component", "near").alias("new"))
        hop = label.select(F.col("id").alias("new"), F.col("component").alias("hop"))
        done = materialize(step.join(hop, "new", "left").select("id", F.col("component").alias("old"), F.least("new", "hop").alias("component")))
        forget(label, near)
        label = done.select("id", "component")
        if not done.filter("old <> component").limit(1).count():
            forget(both)
            return label


def group(docs: DataFrame, width: int = WIDTH, level: int = LEVEL, bands: int = BANDS, rows: int = ROWS, hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's least doc_id) of every document.

    With `hashed` also th, the hash of the text, which tells rows of one doc_id apart.
    """
    docs = documents(docs, F.xxhash64("text").alias("th"))
    sketch = materialize(docs.mapInArrow(tidy(_sketch(width, bands, rows)), "doc_id long, th long, n_shingles long, set_a long, set_b long, buckets array<long>"))
    key = ["n_shingles", "set_a", "set_b"]
    full = sketch.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(full.groupBy(*key).agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.max_by("buckets", "doc_id").alias("buckets")).select(*key, F.col("rep.doc_id").alias("id"), "rep.doc_id", "rep.th", "buckets"))
    shared_ids = materialize(classes.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").select("id"))
    apart = not shared_ids.isEmpty()
    if apart:  # one doc_id has several texts: the least class keeps the id, the others have one by hash
        first = F.row_number().over(Window.partitionBy("id").orderBy("set_a", "set_b", "n_shingles")) == 1
        odd = classes.join(shared_ids, "id", "left_semi").withColumn("id", F.when(first, F.col("id")).otherwise(F.xxhash64("id", "set_a", "set_b", "n_shingles"))).select(classes.columns)
        classes = materialize(classes.join(shared_ids, "id", "left_anti").select(classes.columns).union(odd))
    named = classes.select("id", F.explode("buckets").alias("bucket"))
    shared = named.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    member = materialize(named.join(shared, "bucket"))
    fame = member.groupBy("id").agg(F.sum("m").alias("fame"))
    pivot = member.join(fame, "id").groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("id")).alias("id"))).alias("p")).select("bucket", (-F.col("p.id")).alias("b"))
    wanted = classes.join(fame.select("id"), "id", "left_semi").select("id", "doc_id", "th")
    texts = docs.join(wanted, ["doc_id", "th"]).select("id", "text")
    if apart or not full.groupBy("doc_id", "th").agg(F.count("*").alias("m")).filter("m > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])
    sets = materialize(texts.mapInArrow(tidy(_sets(width)), "id long, n long, s array<long>"))

    pairs = member.join(pivot, "bucket").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    extra = F.array_except("sa", "sb")
    star = compared(pairs, sets).select("a", "b", "na", "nb", extra.alias("extra")).withColumn("same", F.col("na") - F.size("extra"))
    star = materialize(star.select("a", "b", "na", (F.col("nb") - F.col("same")).alias("l"), alike(F.col("same"), level).alias("link"), "extra"))
    links = star.filter("link").select("a", "b")
    label = components(links)

    def of(c):
        return label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))

    told = star.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", "na", "l", "extra", F.coalesce("ca", "a").alias("c"), (F.coalesce("ca", "a") != F.coalesce("cb", "b")).alias("out"))
    told = materialize(told)
    open_ = materialize(told.filter("out").select("b").distinct())
    told = materialize(told.join(open_, "b", "left_semi"))
    own = told.select("a", "b", F.explode("extra").alias("e")).groupBy("b", "e").agg(F.count("*").alias("m"), F.min("a").alias("a")).filter("m = 1").groupBy("a", "b").agg(F.count("*").alias("own"))
    told = told.drop("extra").join(own, ["a", "b"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # |x - y| + |y - x| times (100 + level) may be (100 - level) * (nx + ny) at most, and ny is nx * 100 / level at most.
    most = (100 - level) * F.col("na") * (100 + level) / level
    told = materialize(told.withColumn("need", F.col("l") + F.col("own") - most / (100 + level)).withColumn("spare", F.col("l") - F.col("own")))
    bound = told.groupBy("b").agg(F.max("spare").alias("most_spare"), F.min("need").alias("least_need"), F.max(F.when(F.col("out"), F.col("spare"))).alias("out_spare"), F.min(F.when(F.col("out"), F.col("need"))).alias("out_need"))
    bound = materialize(bound)
    # A class that is out may meet any other; one that isn't meets only those that are.
    told = materialize(told.join(bound, "b").filter("if(out, need <= most_spare and spare >= least_need, need <= out_spare and spare >= out_need)").select("a", "b", "na", "l", "own", "c", "out"))
    x, y = told.filter("out").alias("x"), told.alias("y")
    gap = F.col("x.own") + F.col("y.own") + F.abs(F.col("x.l") - F.col("y.l"))
    allowed = gap * (100 + level) <= (100 - level) * (F.col("x.na") + F.col("y.na"))
    near = 100 * F.least("x.na", "y.na") >= level * F.greatest("x.na", "y.na")
    once = ~F.col("y.out") | (F.col("x.a") < F.col("y.a"))
    rest = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.c") != F.col("y.c")) & once & allowed & near)
    rest = materialize(rest.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct())
    more = compared(rest, sets).filter(alike(F.size(F.array_intersect("sa", "sb")).cast("long"), level)).select("a", "b")
    more = materialize(more)
    if not more.isEmpty():
        label = components(links.union(more))
    named = classes.select(*key, "id", "doc_id").join(label, "id", "left").select(*key, "doc_id", F.coalesce("component", "id").alias("_c"))
    if apart:  # a label may be an id by hash: the component's least doc_id is its name
        least = materialize(named.groupBy("_c").agg(F.min("doc_id").alias("_least")))
        named = named.join(least, "_c").select(*key, F.col("_least").alias("_c"))
    out = sketch.drop("buckets").join(materialize(named.select(*key, "_c")), key, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("_c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *["th"] * hashed, "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
