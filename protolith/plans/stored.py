"""Queries of the stores, suggestions and older readings, on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formulas, text
from ..functions.columns import names as column_names
from ..functions.columns import renamed
from ..operators import cascade, knowledge, legacy, link, lookup, matching, stores, versions
from ..staging import shared_dir
from .documents import row
from .registry import query, read

# --- stores ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS task, CAST(pos AS INTEGER) AS pos, n_name AS name FROM (SELECT o_orderkey, pos, (o_custkey * pos) % 40 AS id FROM orders, (SELECT unnest([1, 2, 3]) AS pos)) JOIN nation ON n_nationkey = id")
def expected_fields(spark, sf_dir):
    """Names of requested ids in the order of the request; unknown ids are left out."""
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pos"), F.col("o_custkey"))
    asked = asked.select("task", "pos", (F.col("o_custkey") * F.col("pos") % 40).alias("id"))
    fields = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return stores.expected(asked, fields)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '值域,' || l_returnflag || ';名称,' || l_linestatus ELSE '值域,' || l_linestatus END AS row FROM lineitem")
def header_rename(spark, sf_dir):
    """Columns under their standard names; where two have one, the last says it and the first has the place."""
    r = F.expr(f"CASE WHEN l_linenumber % 2 = 0 THEN {row(取值范围='l_returnflag', 名称='l_linestatus')} ELSE {row(取值范围='l_returnflag', 范围='l_linestatus')} END")
    targets = F.create_map(*[F.lit(x) for kv in cascade.ALIASES.items() for x in kv])
    out = F.transform(renamed(r, targets), lambda e: F.concat(e["key"], F.lit(","), e["val"]))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(out, ";").alias("row"))


@query("SELECT o_custkey, list_sort(list_distinct(flatten(list(CASE WHEN o_orderkey % 2 = 0 THEN ['a', o_orderstatus] ELSE ['b'] END)))) AS names FROM orders GROUP BY o_custkey")
def distinct_names(spark, sf_dir):
    r = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("a").alias("key")), F.struct(F.col("o_orderstatus").alias("key")))).otherwise(F.array(F.struct(F.lit("b").alias("key"))))
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(r).alias("rows"))
    return g.select("o_custkey", F.sort_array(column_names(F.col("rows"))).alias("names"))


@query("""WITH old AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS name, min(o_orderkey) AS ord FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), new AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS name, min(o_orderkey) AS ord FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
SELECT id, coalesce(new.name, old.name) AS name, CAST(CASE WHEN old.id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS new, coalesce(old.ord, new.ord) AS ord FROM old FULL JOIN new USING (id) WHERE id % 7 <> 0""")
def upsert_fields(spark, sf_dir):
    """Rows by id: the newest value where the id first stood; some deleted."""
    o = read(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("ord"))
    new = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("ord"))
    return stores.deleted(stores.upserted(old, new, "id", "ord"), o.filter("o_custkey % 7 = 0").select(F.col("o_custkey").alias("id")), "id")


@query("""WITH k AS (SELECT 'u' || user_id AS source, event_type AS target, 'default' AS table_id, 0.8::DOUBLE AS confidence, 1 AS hits, event_id AS ord FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'u' || user_id, event_type, 'default', 0.9::DOUBLE, 1, event_id + 1099511627776 FROM events WHERE event_id % 5 = 0)
SELECT source, arg_min(target, ord) AS target, max(confidence) AS confidence, CAST(count(*) AS BIGINT) AS hits FROM k GROUP BY source""")
def apply_mapping(spark, sf_dir):
    """The knowledge base after mappings were applied: hits add up, the first target stays."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("s"), "event_type", "event_id")
    known = e.filter("event_id % 2 = 0").select(F.col("s").alias("source"), F.col("event_type").alias("target"), F.lit("default").alias("table_id"), F.lit(0.8).alias("confidence"), F.lit(1).cast("long").alias("hits"), F.col("event_id").alias("ord"))
    new = e.filter("event_id % 5 = 0").select(F.col("s").alias("original"), F.col("event_type").alias("target"), F.lit(0.9).alias("confidence"), F.lit("").alias("created_at"), F.col("event_id").alias("ord"))
    return stores.applied(new.limit(0), new, known)[1].select("source", "target", "confidence", "hits")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'name is missing' WHEN 1 THEN 'name is over 100 characters' WHEN 2 THEN CASE WHEN p_size > 10 THEN 'confidence is not in 0 to 1' END END AS error FROM part")
def checked_input(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN repeat('a', 101) ELSE p_name END").alias("name"), F.expr("CASE WHEN p_partkey % 4 = 2 THEN p_size / 10 ELSE 1 END").cast("double").alias("confidence"))
    return stores.checked(d, "name", "confidence").select("p_partkey", "error")


@query("SELECT event_type AS target, count(*) AS n FROM events GROUP BY event_type")
def mappings_per_target(spark, sf_dir):
    return stores.per_target(read(spark, sf_dir, "events").select(F.col("event_type").alias("target")))


@query("SELECT count(*) AS common, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderstatus <> 'X') AS different, (count(*) - count(*) FILTER (o_orderkey % 5 = 0 AND o_orderstatus <> 'X')) / count(*) AS rate FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")
def consistency_rate(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    g = o.filter("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END"))
    return stores.consistency(lookup.differences(o.filter("o_orderkey % 11 <> 0"), g, "o_orderkey", ["o_orderstatus"]))


@query("""WITH l AS (SELECT l_returnflag AS name, '' || l_partkey AS content, l_shipdate::VARCHAR AS unit, '' || l_suppkey AS kind, l_orderkey * 100 + l_linenumber AS ord, l_partkey FROM lineitem),
a AS (SELECT name, content, arg_max(unit, ord) AS unit, arg_max(kind, ord) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY name, content, ord ORDER BY unit DESC, kind DESC) AS r FROM l) WHERE r = 1 AND name <> 'N' GROUP BY name, content),
g AS (SELECT name, content, arg_max(CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE unit END, ord) AS unit, arg_max(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE kind END, ord) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY name, content, ord ORDER BY unit DESC, kind DESC) AS r FROM l) WHERE r = 1 AND l_partkey % 7 <> 0 GROUP BY name, content)
SELECT name, content, list_filter([CASE WHEN a.unit <> g.unit THEN 'unit' END, CASE WHEN a.kind <> g.kind THEN 'kind' END], lambda x: x IS NOT NULL) AS fields FROM a JOIN g USING (name, content)""")
def golden_rows(spark, sf_dir):
    """Rows of an export beside those expected, by two columns; of each key the last row counts."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.concat(F.lit(" "), "l_partkey").alias("content"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("unit"), F.col("l_suppkey").cast("string").alias("kind"), F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.col("l_suppkey").cast("string")).alias("ord"), "l_partkey")  # noqa: E741
    actual = l.withColumn("name", F.when(F.col("name") != "N", F.col("name")))
    golden = l.filter("l_partkey % 7 <> 0").withColumn("unit", F.when(F.col("l_partkey") % 3 == 0, "x").otherwise(F.col("unit"))).withColumn("kind", F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit(" "), "kind")))
    return lookup.compared(actual, golden, ["name", "content"], "ord", ["unit", "kind"])


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def common_keys(spark, sf_dir):
    return stores.common_keys(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), read(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("k")), "k")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['a'] WHEN o_orderkey % 3 = 1 THEN ['a', o_orderstatus, 'z'] ELSE [o_orderpriority, o_orderstatus, 'z'] END AS chosen FROM orders")
def toggle_selection(spark, sf_dir):
    """Select all that is shown, or none of it where all is chosen."""
    shown = F.array("o_orderstatus", F.lit("z"))
    chosen = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("z"), F.col("o_orderstatus"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array("o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", stores.toggled(chosen, shown).alias("chosen"))


@query("SELECT n_name AS name, n_regionkey AS region, NULL::BIGINT AS size FROM nation UNION ALL SELECT p_name, NULL, p_size FROM part")
def appended_frames(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return stores.appended([n, read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))])


@query("""SELECT o_custkey AS doc, o_orderkey AS index, o_orderstatus AS first_row, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS columns FROM orders""")
def tables_preview(spark, sf_dir):
    """The first row of each table, and the columns of the document's first."""
    t = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("index"), F.array("o_orderpriority").alias("headers"), F.array("o_orderstatus", F.lit("x")).alias("data_rows"))
    return stores.preview(t).select("doc", "index", "first_row", F.get("columns", 0).alias("columns"))


@query("SELECT table_id, total, high, medium, low FROM (SELECT 't' || (event_id % 3) AS table_id, count(*) AS total, count(*) FILTER (event_id % 100 >= 90) AS high, count(*) FILTER (event_id % 100 >= 70 AND event_id % 100 < 90) AS medium, count(*) FILTER (event_id % 100 < 70) AS low FROM events GROUP BY ALL) UNION ALL SELECT 'all', count(*), count(*) FILTER (event_id % 100 >= 90), count(*) FILTER (event_id % 100 >= 70 AND event_id % 100 < 90), count(*) FILTER (event_id % 100 < 70) FROM events")
def mapping_stats(spark, sf_dir):
    """By table and over all."""
    m = read(spark, sf_dir, "events").select(F.concat(F.lit("t"), F.col("event_id") % 3).alias("table_id"), (F.col("event_id") % 100 / 100.0).cast("double").alias("confidence"))
    return knowledge.stats(m, "table_id", "confidence").union(knowledge.stats(m.withColumn("table_id", F.lit("all")), "table_id", "confidence"))


@query("SELECT source, table_id, hits FROM (SELECT 'u' || user_id AS source, 't' || (event_id % 3) AS table_id, count(*) AS hits, min(event_id) AS ord FROM events GROUP BY ALL) ORDER BY hits DESC, ord LIMIT 10")
def kb_top_hits(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.lit("").alias("target"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("table_id"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("hits"), F.col("event_id").alias("ord"))
    return knowledge.folded(e, "ord").orderBy(F.desc("hits"), "first_seen").limit(10).select("source", "table_id", "hits")


@query("""WITH e AS (SELECT 'u' || user_id AS original, event_type, event_id % 100 / 100.0 AS confidence, event_id + (event_id % 3) * 1000000000 AS ord FROM events)
SELECT original, arg_max(event_type, ord) AS target, CAST(arg_max(confidence, ord) AS DOUBLE) AS confidence, arg_min(event_type, ord) AS first_target, CAST(max(confidence) AS DOUBLE) AS surest, CAST(count(*) AS BIGINT) AS hits FROM e GROUP BY original""")
def saved_mappings(spark, sf_dir):
    """Mappings saved in three versions of a store, each with the knowledge base that learns them, and read back."""
    store = versions.Store(spark, f"{shared_dir(spark).rstrip('/')}/protolith/{uuid.uuid4().hex}-store")
    e = read(spark, sf_dir, "events")
    for k in range(3):
        part = e.filter(F.col("event_id") % 3 == k)
        versions.save_mappings(store, part.select(F.concat(F.lit("u"), "user_id").alias("original"), F.col("event_type").alias("target"), (F.col("event_id") % 100 / 100.0).cast("double").alias("confidence"), F.lit("").alias("created_at"), (F.col("event_id") + k * 1_000_000_000).alias("ord")))
    saved = store.read()
    learnt = saved["knowledge"].select(F.col("source").alias("original"), F.col("target").alias("first_target"), F.col("confidence").alias("surest"), "hits")
    return saved["mappings"].select("original", "target", "confidence").join(learnt, "original")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def history_kept(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("raw_tables", F.array(F.lit(1)))
    return stores.history(o, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_partkey % 6 IN (0, 1) AS taken, p_partkey % 6 = 5 AS protocol, CASE WHEN p_partkey % 6 = 4 THEN substr(repeat('甲', 30), 1, 20) ELSE '某' || p_size END AS sheet, '协议_' || strftime(TIMESTAMP '2024-01-02 03:04:05' + to_days(CAST(p_size AS INTEGER)), '%Y%m%d%H%M%S') || '.xlsx' AS stamped FROM part")
def file_names(spark, sf_dir):
    """Which files are taken, and the names of sheets and exports."""
    name = F.expr("CASE p_partkey % 6 WHEN 0 THEN p_name || '.DOCX' WHEN 1 THEN 'd.x/a.csv' WHEN 2 THEN '~a.docx' WHEN 3 THEN 'a/~$b.docx' WHEN 4 THEN 'docx' ELSE '某协议.txt' END")
    sheet = F.expr("CASE p_partkey % 6 WHEN 4 THEN repeat('甲', 30) ELSE '某通信协议' || p_size END")
    at = F.expr("TIMESTAMP_NTZ '2024-01-02 03:04:05' + make_interval(0, 0, 0, p_size)")
    return read(spark, sf_dir, "part").select("p_partkey", stores.accepted_file(name).alias("taken"), stores.protocol_file(name).alias("protocol"), stores.sheet_name(sheet).alias("sheet"), stores.stamped(at).alias("stamped"))


# --- suggestions ----------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT p_brand AS source, 'T' || p_size AS target, count(*) AS hits, min(p_partkey) AS ord FROM part GROUP BY ALL), c AS (SELECT s.source, k.target, 1.0::DOUBLE AS confidence, 'exact' AS match_type, k.hits, k.ord FROM (SELECT DISTINCT lower(p_brand) AS source FROM part) s JOIN k ON s.source = lower(k.source)),
d AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, hits DESC, ord) AS r FROM c)
SELECT source, CAST(rank AS INTEGER) AS rank, target, hits FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, hits DESC, ord) AS rank FROM d WHERE r = 1) WHERE rank <= 10""")
def knowledge_exact(spark, sf_dir):
    """What the knowledge base says of names but for case, by hits."""
    k = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source"), F.concat(F.lit("T"), "p_size").alias("target")).agg(F.count("*").alias("hits"), F.min("p_partkey").alias("ord"))
    none = spark.createDataFrame([], "field string, word string, similarity double")
    return stores.knowledge_query(k, k.select(F.lower("source").alias("source")).distinct(), none).select("source", "rank", "target", "hits")


@query()
def knowledge_query(spark, sf_dir):
    """The best targets of each part name among the names of the knowledge base, alike ones included."""
    p = read(spark, sf_dir, "part")
    k = p.groupBy(F.col("p_name").alias("source"), F.col("p_brand").alias("target")).agg(F.count("*").alias("hits"), F.min("p_partkey").alias("ord"))
    asked = p.select(F.upper("p_name").alias("source")).distinct()
    words = k.select(F.lower("source").alias("word")).distinct().withColumn("ord", F.lit(0))
    return stores.knowledge_query(k, asked, cascade.near(asked.select(F.lower("source").alias("field")), words, 0.6))


@query("""WITH s AS (SELECT q.vec_id AS field, v.vec_id AS word, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 4) AS similarity, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT 'v' || field AS field, 'v' || word AS word, similarity FROM s WHERE s >= 0.82""")
def semantic_match(spark, sf_dir):
    """All words whose vectors are alike from 0.82 on, of the query set against all rows."""
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("t"), F.col("embedding").alias("vector"), "vec_id")
    return matching.semantic(e.filter("vec_id % 100 = 0").select(F.col("t").alias("field"), "vector"), e.select(F.col("t").alias("word"), F.col("vec_id").alias("ord"), "vector")).select("field", "word", "similarity")


@query("""WITH s AS (SELECT q.vec_id AS field, v.vec_id AS word, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT 'v' || field AS field, 'v' || word AS word, round(s, 4) AS similarity FROM s WHERE s >= 0.72""")
def semantic_blocks(spark, sf_dir):
    """Proposals by meaning, from 0.72 on, of the query set against all rows, in blocks of vectors."""
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("t"), F.col("embedding").alias("vector"), "vec_id")
    return matching.semantic(e.filter("vec_id % 100 = 0").select(F.col("t").alias("field"), "vector"), e.select(F.col("t").alias("word"), F.col("vec_id").alias("ord"), "vector"), 0.72, most=0).select("field", "word", "similarity")


@query()
def detailed_suggestions(spark, sf_dir):
    """What is found of each name, and proposals for those that aren't found."""
    p, n = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    known = n.select(F.col("n_name").alias("source"), F.lit("T").alias("target"), F.lit(0.8).alias("confidence"), F.col("n_nationkey").alias("ord"))
    words = n.select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("ord"))
    fields = n.select(F.concat(F.lit("the"), F.substring("n_name", 2, 5), F.col("n_nationkey")).alias("field")).union(p.select("p_brand")).union(n.select("n_name"))
    return cascade.detailed(fields, known, words).select("field", "kind", "matched", "confidence", F.size(F.coalesce("suggestions.word", F.array())).alias("n"))


@query("""WITH pairs AS (SELECT s_suppkey % 10 AS task, 's' || s_suppkey AS source, n_name AS target, n_nationkey AS ord, ((s_suppkey * 7 + n_nationkey * 13) % 100) / 100.0::DOUBLE AS similarity, n_nationkey % 3 <> 0 AS available FROM supplier, nation),
top AS (SELECT *, row_number() OVER (PARTITION BY task, source ORDER BY similarity DESC, ord) AS r FROM pairs WHERE similarity > 0.5),
shown AS (SELECT *, row_number() OVER (PARTITION BY task, source ORDER BY r) AS rank FROM top WHERE r <= 5 AND available)
SELECT task, source, CAST(rank AS INTEGER) AS rank, target, similarity FROM shown WHERE rank <= 3""")
def batch_suggest(spark, sf_dir):
    """Of the five best targets of each source the first three that are available."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    pairs = s.join(F.broadcast(n)).select((F.col("s_suppkey") % 10).alias("task"), F.concat(F.lit("s"), "s_suppkey").alias("source"), F.col("n_name").alias("target"), F.col("n_nationkey").alias("ord"), (((F.col("s_suppkey") * 7 + F.col("n_nationkey") * 13) % 100) / F.lit(100.0)).alias("similarity"), (F.col("n_nationkey") % 3 != 0).alias("available"))
    return cascade.targets_for(pairs)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 WHEN p_partkey % 3 = 1 THEN 0.95 ELSE greatest(0.4, p_size / 100.0) END::DOUBLE AS similarity FROM part""")
def combined_likeness(spark, sf_dir):
    """Equal, equal but for case, else the greater of the lexical likeness and what is known."""
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.upper("p_brand")).otherwise("x")
    return read(spark, sf_dir, "part").select("p_partkey", cascade.likeness(F.col("p_brand"), other, F.lit(0.4), F.col("p_size") / 100.0).alias("similarity"))


# --- older readings -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'UINT16' WHEN 1 THEN 'INT32' WHEN 2 THEN 'UFLOAT32' WHEN 3 THEN 'DOUBLE64' ELSE 'Nan' END AS type, CAST(CASE p_partkey % 5 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 32 WHEN 3 THEN 64 ELSE 0 END AS INTEGER) AS bits, CAST(CASE p_partkey % 5 WHEN 0 THEN 16 WHEN 3 THEN 32 ELSE 0 END AS INTEGER) AS listed FROM part")
def legacy_types(spark, sf_dir):
    t = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'USHORT' WHEN 1 THEN 'Integer-32 ' || p_size WHEN 2 THEN 'ufloat' WHEN 3 THEN 'DOUBLE' ELSE p_brand END")
    d = read(spark, sf_dir, "part").select("p_partkey", legacy.standard(t).alias("s"), legacy.listed_bits(t).alias("listed"))
    return d.select("p_partkey", "s.type", "s.bits", "listed")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'BC' ELSE 'RT' || p_size END AS source, CASE WHEN p_partkey % 2 = 0 THEN ' RT' || p_size ELSE 'BC' END AS target, '' || p_partkey AS sub, CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '' || p_size END AS length FROM part")
def bus_split(spark, sf_dir):
    t = F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'BC RT' ELSE 'RT' END || p_size || '-SA' || p_partkey || '-' || CASE WHEN p_partkey % 3 = 0 THEN '模式码3' ELSE p_size || '字' END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' BC' END")
    return read(spark, sf_dir, "part").select("p_partkey", legacy.bus_parts(t).alias("p")).select("p_partkey", "p.*")


@query("SELECT p_partkey, '名（甲）' AS han, CASE WHEN p_size % 2 = 0 THEN [1] ELSE [] END::INTEGER[] AS missing, [p_brand, p_name] AS picked, [p_name, p_brand] AS unrepeated, ['c', p_brand] AS column_ FROM part")
def older_lists(spark, sf_dir):
    """Ideographs only, an ordered difference, picked cells, a row without repeats, a column."""
    b = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"), F.col("p_brand"))).otherwise(F.array(F.lit("x"), F.col("p_brand"), F.col("p_name")))
    g = F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array("p_name", "p_name", "p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", text.han_only(F.concat("p_name", F.lit(" 名(甲)"))).alias("han"), legacy.ordered_difference(F.array(F.lit("x"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")), F.col("p_brand")), b).alias("missing"), legacy.picked(F.array("p_name", F.lit("-"), "p_brand"), F.array(F.lit(2), F.lit(0))).alias("picked"), legacy.row_cells(g, F.lit(1)).alias("unrepeated"), legacy.column_cells(g, F.lit(2)).alias("column_"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def unique_rows(spark, sf_dir):
    return legacy.unique_rows(read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_type", "event_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS parent FROM part")
def two_level_header(spark, sf_dir):
    info = F.when(F.col("p_partkey") % 3 != 1, F.array(F.lit("名称"), F.lit("名称"), F.col("p_name"), F.lit("上级"), F.col("p_brand"))).otherwise(F.array(F.lit("名称"), F.col("p_name")))
    head = F.when(F.col("p_partkey") % 3 != 2, F.array(F.lit("序号"), F.lit("内容"))).otherwise(F.array(F.lit("序号")))
    found = legacy.two_levels(F.array(info, head), F.lit(0), F.lit(1), F.array(F.lit("名称"), F.lit("上级")), F.array(F.lit("内容"), F.lit("序号")))
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.name", "f.parent")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE o_orderkey % 5 <> 0 AND NOT (r = 1 AND o_orderkey % 2 = 0)")
def older_row_filters(spark, sf_dir):
    """Without notes, and without a checksum at a table's end."""
    o = read(spark, sf_dir, "orders").withColumn("first", F.when(F.col("o_orderkey") % 5 == 0, "注1").otherwise("1")).withColumn("text", F.when(F.col("o_orderkey") % 2 == 0, "CRC校验").otherwise("x"))
    return legacy.data_rows(o, ["o_custkey"], "o_orderkey", "first", "text").select("o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT p_partkey AS ord, p_partkey AS name FROM part), f AS (SELECT n.ord, n.name, c_name FROM n LEFT JOIN customer ON c_custkey = n.name AND c_custkey % 3 = 1)
SELECT ord, name, c_name FROM f WHERE ord BETWEEN (SELECT min(ord) FROM f WHERE c_name IS NOT NULL) AND (SELECT max(ord) FROM f WHERE c_name IS NOT NULL)""")
def names_with_gaps(spark, sf_dir):
    """Rows in the order of a list of names, a gap for each name without one between the first and the last."""
    n = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("name"))
    return legacy.reordered(n, read(spark, sf_dir, "customer").filter("c_custkey % 3 = 1").select(F.col("c_custkey").alias("name"), "c_name"), "name", "ord")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1 THEN o_orderpriority ELSE '' END AS o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0")
def framed_messages(spark, sf_dir):
    """Lines beside their order's head, which stands on the first line only."""
    heads = read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = read(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return legacy.framed(rows, heads, ["l_orderkey"], "at", ["o_orderpriority"]).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority")


@query("""WITH e AS (SELECT n_regionkey AS doc, n_nationkey AS pos, n_name AS m FROM nation), n AS (SELECT DISTINCT c_nationkey % 5 AS doc, 'pre ' || n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT n.doc, name, 'I' || arg_min(pos, pos) AS id FROM n JOIN e ON n.doc = e.doc AND (contains(m, name) OR contains(name, m)) GROUP BY n.doc, name""")
def message_entry(spark, sf_dir):
    """The ID of the first message that holds a name or is held by it."""
    n = read(spark, sf_dir, "nation")
    r = F.sort_array(F.collect_list(F.struct("n_nationkey", F.expr(row(信息内容="n_name", 消息ID="'I' || n_nationkey")).alias("r"))))
    t = n.groupBy(F.col("n_regionkey").alias("doc")).agg(r.alias("x")).select("doc", F.lit(0).alias("index"), F.array(F.lit("信息内容"), F.lit("消息ID")).alias("headers"), F.col("x.r").alias("data_rows"))
    names = read(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select((F.col("c_nationkey") % 5).alias("doc"), F.concat(F.lit("pre "), "n_name").alias("name")).distinct()
    return link.message_entry(t, names, {"id": ("消息ID", "消息标识")})


@query("SELECT event_id, event_id % 5 IN (0, 1, 3) AS mathematical, event_id % 5 = 0 AS short_, CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS INTEGER) AS family, 'f' || user_id || '.xlsx' AS file, 'u' || substr(lpad('' || user_id, 9, '0'), 1, 7) AS id FROM events")
def small_predicates(spark, sf_dir):
    """Arithmetic, short factors, protocol families, file stems, short ids."""
    t = F.expr("CASE event_id % 5 WHEN 0 THEN '乘以9' WHEN 1 THEN user_id || 'x+1' WHEN 2 THEN 'a' || user_id WHEN 3 THEN 'LSB = ' || user_id ELSE '某' END")
    name = F.expr("CASE event_id % 4 WHEN 0 THEN '总线' WHEN 1 THEN '串行' WHEN 2 THEN '网络' ELSE 'x' END")
    e = read(spark, sf_dir, "events")
    return e.select("event_id", formulas.is_mathematical(t).alias("mathematical"), formulas.is_short_factor(t, F.lit("某说明")).alias("short_"), text.family(name).alias("family"), F.concat(text.stem(F.concat(F.lit("f"), "user_id", F.lit(".docx"))), F.lit(".xlsx")).alias("file"), text.short_id(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).alias("id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'F' AND row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) = 1 THEN '某' ELSE '' END AS name FROM lineitem""")
def first_plain_row(spark, sf_dir):
    """A table's name on its first row that isn't one of bits."""
    rows = read(spark, sf_dir, "lineitem").withColumn("bit", F.col("l_linestatus") != "F")
    order = Window.partitionBy("l_orderkey", "bit").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumn("name", F.when(~F.col("bit") & (F.row_number().over(order) == 1), "某").otherwise("")).select("l_orderkey", "l_linenumber", "l_partkey", "name")


# --- the knowledge base, searched and counted -----------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'blue') OR contains(lower(p_type), 'blue')) AND p_brand = 'Brand#11'")
def knowledge_search(spark, sf_dir):
    """Mappings by a word in source or target, of one table."""
    k = read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("source"), F.col("p_type").alias("target"), F.col("p_brand").alias("table_id"))
    return knowledge.searched(k, "Blue", "Brand#11").select("p_partkey")


@query("""SELECT table_id, whole, total, high, medium, low FROM (SELECT CASE WHEN event_id % 4 > 0 THEN 't' || (event_id % 4) END AS table_id, false AS whole, count(*) AS total, count(*) FILTER (event_id % 100 >= 90) AS high, count(*) FILTER (event_id % 100 BETWEEN 70 AND 89) AS medium, count(*) FILTER (event_id % 100 < 70) AS low FROM events GROUP BY ALL)
UNION ALL SELECT NULL, true, count(*), count(*) FILTER (event_id % 100 >= 90), count(*) FILTER (event_id % 100 BETWEEN 70 AND 89), count(*) FILTER (event_id % 100 < 70) FROM events""")
def stats_of_all(spark, sf_dir):
    """By table and over all in one pass, with mappings of no table."""
    m = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("t"), F.col("event_id") % 4)).alias("table_id"), (F.col("event_id") % 100 / 100.0).cast("double").alias("confidence"))
    return knowledge.all_stats(m, "table_id", "confidence")


@query("""WITH f AS (SELECT c_nationkey AS doc, c_mktsegment AS field, min(CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'unmatched' END) AS k FROM customer WHERE c_nationkey % 4 > 0 GROUP BY ALL),
q AS (SELECT doc, count(*) AS total, count(*) FILTER (k = 'exact') AS e, count(*) FILTER (k = 'semantic') AS s FROM f GROUP BY doc)
SELECT n_nationkey AS doc, coalesce(total, 0) AS total, coalesce(e, 0) AS exact_count, coalesce(s, 0) AS fuzzy_count, coalesce(round((e + 0.85::DOUBLE * s) / total, 3), 0) AS score,
  CASE WHEN total IS NULL THEN 'unknown' WHEN (e + 0.85::DOUBLE * s) / total > 0.9 THEN 'excellent' WHEN (e + 0.85::DOUBLE * s) / total > 0.7 THEN 'good' ELSE 'poor' END AS level FROM nation LEFT JOIN q ON doc = n_nationkey""")
def quality_of_documents(spark, sf_dir):
    """Mapping quality over distinct fields; documents without fields are unknown."""
    c = read(spark, sf_dir, "customer").filter("c_nationkey % 4 > 0").select(F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("field"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'unmatched' END").alias("k"))
    groups = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"))
    return knowledge.distinct_quality(groups, c, ["doc"], "field", "k").select("doc", "total", "exact_count", "fuzzy_count", "score", "level")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_with_total(spark, sf_dir):
    return knowledge.page_of(read(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 3, 20).select("o_orderkey", "total")
