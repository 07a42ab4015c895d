"""Queries of the grid, classifier, formula and cascade operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas, names
from ..operators import cascade, classify, grid
from .registry import query, read


@query("""
WITH cells AS (SELECT user_id, event_id, p, CASE WHEN p = 1 THEN 1 + event_id % 2 ELSE 1 END AS k, CASE WHEN p = 0 THEN CASE event_id % 3 WHEN 0 THEN 'restart' WHEN 1 THEN 'continue' END END AS m, event_type || p AS t FROM events, (SELECT unnest([0, 1, 2]) AS p)),
placed AS (SELECT *, CAST(coalesce(sum(k) OVER (PARTITION BY user_id, event_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c0 FROM cells),
filled AS (SELECT *, coalesce(last_value(CASE WHEN m IS NULL OR m = 'restart' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id, c0 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS v FROM placed WHERE c0 < 3)
SELECT user_id, event_id, CAST(unnest(range(c0, least(c0 + k, 3))) AS INTEGER) AS c, v AS text, coalesce(m <> 'restart', false) AS continued FROM filled""")
def grid_merge_expand(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p"))
    merge = F.expr("CASE WHEN p = 0 THEN CASE event_id % 3 WHEN 0 THEN 'restart' WHEN 1 THEN 'continue' END END")
    cells = e.select("user_id", "event_id", "p", F.when(F.col("p") == 1, 1 + F.col("event_id") % 2).cast("int").alias("k"), merge.alias("m"), F.concat("event_type", "p").alias("t"), F.lit(3).alias("n"))
    return grid.expanded(cells, ["user_id"], "event_id", "p", "k", "m", "t", "n")


@query("""
WITH b AS (SELECT user_id, event_id, event_id % 3 = 0 AS t, event_id % 3 <> 0 AND event_id % 7 <> 0 AS p, event_id % 5 = 0 AS noise, event_type FROM events),
l AS (SELECT *, last_value(CASE WHEN p THEN event_id END IGNORE NULLS) OVER w AS lp, last_value(CASE WHEN p THEN event_type END IGNORE NULLS) OVER w AS preceding, max(CASE WHEN p AND noise THEN event_id END) OVER w AS last_noise
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, max(CASE WHEN t AND (lp IS NULL OR lp % 5 <> 0) THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cleared FROM l)
SELECT user_id, event_id, coalesce(preceding, '') AS preceding, coalesce(last_noise > coalesce(cleared, -1), false) AS skipped FROM c WHERE t""")
def caption_and_noise(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN 'tbl' ELSE 'p' END").alias("kind"), F.expr("CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END").alias("text"))
    return grid.captions(e, "user_id", "event_id", F.col("kind"), "text", F.col("event_id") % 5 == 0)


_CAPTION = "CASE p_partkey % 5 WHEN 0 THEN '表' || p_size || ' 某' || p_name WHEN 1 THEN '表B.' || p_size || '某' || p_name WHEN 2 THEN '' || p_size || ' 一二' WHEN 3 THEN ' 某' || p_brand ELSE '表' END"


@query(f"SELECT p_partkey, caption, CASE p_partkey % 5 WHEN 0 THEN '某' || p_name WHEN 1 THEN '某' || p_name WHEN 2 THEN '' WHEN 3 THEN '某' || p_brand ELSE '' END AS name FROM (SELECT *, {_CAPTION} AS caption FROM part)")
def caption_name(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(_CAPTION).alias("caption")).withColumn("name", names.of_caption(F.col("caption")))


_ROW = "CASE o_orderkey % 4 WHEN 0 THEN {l}'信息名称', '12', o_orderpriority, 'xx'{r} WHEN 1 THEN {l}'', '—', '其他', 'A'{r} WHEN 2 THEN {l}'AB', o_orderpriority{r} ELSE {l}'信源', ' 某B '{r} END"


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' WHEN 2 THEN 'AB' ELSE '某B' END AS name FROM orders")
def info_row_name(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", names.of_row(F.expr(_ROW.format(l="array(", r=")"))).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'BC' END AS source, CASE WHEN p_partkey % 2 = 0 THEN '' || p_size END AS target, '' || p_partkey AS sub, CASE WHEN p_size % 3 > 0 THEN '' || p_size END AS length FROM part""")
def bus_address(spark, sf_dir):
    told = F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'BC→rt ' || p_size || '-' ELSE '' END || 'SA' || p_partkey || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '-模式码0x' || hex(p_size) ELSE '-模式码 ' || p_size END")
    m = read(spark, sf_dir, "part").select("p_partkey", names.bus_address(told).alias("m"))
    keys = {"source": "信源机器码", "target": "信宿机器码", "sub": "子地址", "length": "数据段长度"}
    return m.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(c) for c, k in keys.items()])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS route, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'first' END AS start FROM orders")
def key_value_harvest(spark, sf_dir):
    row = F.expr("array(CASE WHEN o_orderkey % 2 = 0 THEN '信源、信目' ELSE '—' END, o_orderpriority, '发起时机', 'first', CASE WHEN o_orderkey % 3 = 0 THEN '其他发起时机' ELSE '其他' END, o_orderstatus, '备注')")
    m = read(spark, sf_dir, "orders").select("o_orderkey", names.pairs(row).alias("m"))
    return m.select("o_orderkey", F.try_element_at("m", F.lit("信源、信宿")).alias("route"), F.try_element_at("m", F.lit("发起时机")).alias("start"))


#: Grids of the eight kinds that the classifier's ladder tells apart, first row first.
_GRIDS = [
    "信源系统码 信宿系统码 信息内容|1 2 3", "消息ID 信息内容|0x1 a", "位号 状态参数 BIT", "字节 状态参数|位号 x",
    "名称 内容 类型|a b float", "名称 内容|a b", "周期 字节|a b", "帧头 字节|帧尾 x",
]


@query("""SELECT o_orderkey, o_orderkey % 8 >= 5 OR o_orderkey % 16 = 4 AS noise, CASE o_orderkey % 8 WHEN 0 THEN 'port_allocation' WHEN 1 THEN 'message_id' WHEN 2 THEN 'bit_def' WHEN 3 THEN 'bit_def' ELSE 'field_def' END AS kind FROM orders""")
def table_kinds(spark, sf_dir):
    told = F.element_at(F.array(*map(F.lit, _GRIDS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    g = F.transform(F.split(told, r"\|"), lambda r: F.split(r, " "))
    o = read(spark, sf_dir, "orders").select("o_orderkey", g.alias("g"), F.when(F.col("o_orderkey") % 16 == 4, "测试用").alias("caption"))
    return o.select("o_orderkey", classify.is_noise(F.col("g"), F.col("caption")).alias("noise"), classify.kind(F.col("g")).alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 7 = 0""")
def data_rows(spark, sf_dir):
    cases = [("某名", "UINT8"), ("某名", "—"), ("注：某", "UINT8"), ("传输周期", "UINT8"), ("序号", "类型"), ("某名", "参见附录A"), ("", " ")]
    row = F.element_at(F.array(*[F.array(F.struct(F.lit("内容").alias("key"), F.lit(a).alias("val")), F.struct(F.lit("类型").alias("key"), F.lit(b).alias("val"))) for a, b in cases]), (F.col("l_partkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").filter(classify.is_data(row)).select("l_orderkey", "l_linenumber", "l_partkey")


_FORMULA = "CASE l_partkey % 8 WHEN 0 THEN '乘以' || q || '+3' WHEN 1 THEN '除以' || q WHEN 2 THEN '(X/2^12)×' || q WHEN 3 THEN q || 'X - 2' WHEN 4 THEN '分辨率 0.' || q WHEN 5 THEN 'a' || q || 'b' WHEN 6 THEN '0.' || q || '°' ELSE '—' END"


@query(f"""
SELECT l_orderkey, l_linenumber, described, CASE l_partkey % 8 WHEN 0 THEN q || 'x+3' WHEN 1 THEN format('{{:g}}', 1.0::DOUBLE / q) || 'x+0' WHEN 2 THEN format('{{:g}}', q::DOUBLE / 4096) || 'x+0' WHEN 3 THEN q || 'x-2'
  WHEN 4 THEN format('{{:g}}', CAST('0.' || q AS DOUBLE)) || 'x+0' WHEN 6 THEN format('{{:g}}', CAST('0.' || q AS DOUBLE)) || 'x+0' ELSE described END AS formula
FROM (SELECT *, {_FORMULA} AS described FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem))""")
def formula_standardize(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")).select("l_orderkey", "l_linenumber", F.expr(_FORMULA).alias("described"))
    return d.withColumn("formula", formulas.standardized(F.col("described")))


@query("""SELECT event_id, event_id % 6 IN (0, 1, 3, 4) AS formula, event_id % 6 IN (3, 5) AS enumeration FROM events""")
def formula_predicates(spark, sf_dir):
    d = F.expr("CASE event_id % 6 WHEN 0 THEN '乘以 ' || user_id WHEN 1 THEN user_id || 'X+1' WHEN 2 THEN '' || user_id WHEN 3 THEN '0x1:on ' || user_id || ':off' WHEN 4 THEN '(v/' || user_id || ')×2' ELSE '{1, ' || user_id || '}' END")
    return read(spark, sf_dir, "events").select("event_id", formulas.has_formula(d).alias("formula"), formulas.tells_values(d).alias("enumeration"))


@query("""SELECT user_id, string_agg(event_id || ':' || substr(event_type, 1, 4), ',' ORDER BY event_id) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 10 GROUP BY user_id""")
def recognition_preview(spark, sf_dir):
    row = F.struct("event_id", F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("val")) for k, c in (("类型", "event_type"), ("_mark", "value"))]).alias("row"))
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    cut = grid.preview(F.col("rows.row"), 10, 4)
    ids = F.slice(F.col("rows.event_id"), 1, 10)
    return g.select("user_id", F.array_join(F.zip_with(ids, cut, lambda i, r: F.concat(i.cast("string"), F.lit(":"), F.array_join(r["val"], ","))), ",").alias("shown"))


@query()
def match_cascade(spark, sf_dir):
    n, p = read(spark, sf_dir, "nation"), read(spark, sf_dir, "part")
    known = n.select(F.col("n_name").alias("source"), F.lit("known").alias("target"), (0.85 + F.col("n_regionkey") / 20).alias("confidence"), F.col("n_nationkey").alias("ord"))
    named = spark.createDataFrame([(a + t,) for a in cascade.ALIASES for t in ("", "1")], "field string")
    fields = n.select(F.col("n_name").alias("field")).union(p.select("p_name")).union(p.select(F.concat("p_brand", F.lit("x")))).union(named)
    words = p.groupBy(F.col("p_brand").alias("word")).agg(F.min("p_partkey").alias("ord")).union(n.select("n_name", F.col("n_nationkey").cast("long")))
    return cascade.cascade(fields, known, words)
