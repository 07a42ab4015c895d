"""Queries of understanding, linking, normalising and exporting tables, on tables made of orders, parts and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, remarks, text, units
from ..operators import export, extract, link, normalise, stores, tables
from ..staging import staged
from .registry import query, read, spread


def row(**cells) -> str:
    """SQL of a row; cells by column name, each an SQL expression."""
    return "array(" + ", ".join(f"struct('{k}' AS key, CAST({v} AS STRING) AS val)" for k, v in cells.items()) + ")"


# --- headers and aggregate tables -----------------------------------------------------------------------------------

#: A grid with an info row, o_orderkey % 9 rows of metadata, a header and two rows of data.
_META_ROWS = "transform(sequence(1, 8), i -> CASE i % 3 WHEN 0 THEN array('传输周期', '非周期', '其他', o_orderpriority) WHEN 1 THEN array('信源、信宿', 'BC→RT' || o_custkey || '-SA' || i || '-模式码0x1F') ELSE array('发起时机', '第' || i, '错误处理', '-') END)"
_GRID = f"concat(array(array('信息名称', '消息' || o_custkey, '信息标识', 'xx')), slice({_META_ROWS}, 1, CAST(o_orderkey % 9 AS INT)), array(array('序号', '内容', '类型', '值域'), array('1', '某量', 'UINT8', '0~1'), array('2', '注：某', 'UINT8', '—')))"


@query("""
SELECT o_orderkey, CASE WHEN n > 6 THEN 'skip' ELSE 'field_def' END AS table_type, CASE WHEN n > 6 THEN '' ELSE '消息' || o_custkey END AS msg_name, CAST(CASE WHEN n <= 6 THEN n + 1 END AS INTEGER) AS header,
  CASE WHEN n BETWEEN 1 AND 6 THEN '' || o_custkey END AS target, CASE WHEN n BETWEEN 1 AND 6 THEN '' || (CASE WHEN n < 4 THEN 1 ELSE 4 END) END AS sub, CASE WHEN n BETWEEN 1 AND 6 THEN '31' END AS length,
  CASE WHEN n BETWEEN 2 AND 6 THEN '第' || (CASE WHEN n < 5 THEN 2 ELSE 5 END) END AS start, CAST(CASE WHEN n <= 6 THEN 2 END AS INTEGER) AS n_rows FROM (SELECT *, o_orderkey % 9 AS n FROM orders)""")
def aggregate_tables(spark, sf_dir):
    d = spread(read(spark, sf_dir, "orders")).select("o_orderkey", F.expr(_GRID).alias("grid"), F.lit("").alias("caption"))
    d = d.withColumn("u", tables.understood(F.col("grid"), F.col("caption"))).withColumn("rows", F.when(F.col("u.header").isNotNull(), tables.data_rows(F.col("grid"), F.col("u.header"))))
    told = lambda k, c: F.try_element_at("u.meta", F.lit(k)).alias(c)
    return d.select("o_orderkey", "u.table_type", "u.msg_name", "u.header", told("信宿机器码", "target"), told("子地址", "sub"), told("数据段长度", "length"), told("发起时机", "start"), F.size("rows").alias("n_rows"))


_HEADS = "CASE p_partkey % 7 WHEN 0 THEN array('数据项名称', '消息', '计算结果' || p_size, 'x') WHEN 1 THEN array('数据项名称', 'UINT8 型', '', '—') WHEN 2 THEN array('名称', '类型') WHEN 3 THEN array('代号', '值') WHEN 4 THEN array('甲', '序号 内容', 'c') WHEN 5 THEN array('数据项名称', '', '—', '—') ELSE array('消息类型', '类型', '甲') END"


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 3 THEN 'skip' ELSE 'field_def' END AS table_type,
  CASE p_partkey % 7 WHEN 0 THEN '消息' WHEN 1 THEN '某' || p_brand || '聚合式' WHEN 2 THEN '名称' WHEN 3 THEN '' WHEN 4 THEN '甲' WHEN 5 THEN '某' || p_brand || '聚合式' ELSE '消息类型' END AS msg_name,
  CAST(CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 3 THEN NULL WHEN 6 THEN 1 ELSE 0 END AS INTEGER) AS header FROM part""")
def aggregate_names(spark, sf_dir):
    """Names of tables that a caption calls aggregate: from the first row, else from the caption."""
    body = "array(array('序号', '内容', '类型'), array('1', '某', 'UINT8'))"
    d = read(spark, sf_dir, "part").select("p_partkey", F.expr(f"concat(array({_HEADS}), {body})").alias("grid"), F.when(F.col("p_partkey") % 7 == 3, F.lit("某")).otherwise(F.concat(F.lit("某"), "p_brand", F.lit("聚合式"))).alias("caption"))
    d = d.withColumn("u", tables.understood(F.col("grid"), F.col("caption")))
    return d.select("p_partkey", "u.table_type", "u.msg_name", "u.header")


@query("""SELECT l_orderkey, l_linenumber, '字段' || l_partkey AS content, CASE WHEN l_linenumber % 2 = 0 THEN 'UINT16' ELSE '' || CAST(l_quantity AS INTEGER) END AS told FROM lineitem WHERE l_partkey % 5 <> 0""")
def projected_rows(spark, sf_dir):
    """Rows of grids under headers with repeats and empty cells; rows of metadata are left out, of columns of one name the last wins."""
    cells = F.expr("array('' || l_linenumber, '字段' || l_partkey, '字段' || l_partkey, CASE WHEN l_partkey % 5 = 0 THEN '—' ELSE '' || CAST(l_quantity AS INT) END, CASE WHEN l_linenumber % 2 = 0 THEN 'UINT16' ELSE '—' END, '')")
    lines = spread(read(spark, sf_dir, "lineitem"), by=("l_orderkey",)).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("c")))).alias("x"))
    head = "array(array('序号', '内容', '内容', '类型', '格式', ''))"
    g = lines.select("l_orderkey", F.concat(F.expr(head), F.col("x.c")).alias("grid"))
    r = g.select("l_orderkey", F.explode(tables.data_rows(F.col("grid"), F.lit(0))).alias("r"))
    cell = lambda k: F.get(F.filter("r", lambda e: e["key"] == k), 0)["val"]
    told = F.when(cell("序号").cast("int") % 2 == 0, cell("格式")).otherwise(cell("类型"))
    return r.filter(cell("类型") != "—").select("l_orderkey", cell("序号").cast("int").alias("l_linenumber"), cell("内容").alias("content"), told.alias("told"))


@query("""SELECT p_partkey, p_partkey % 8 IN (0, 6, 7) AS valid FROM part""")
def row_validity(spark, sf_dir):
    cases = ["'某量', 'UINT8'", "'检查结果', 'UINT8'", "'聚合式的信息流表征示意1', 'x'", "'某量', '—'", "'按实际操作流程', 'x'", "' 序号', ' '", "'检查结果1', 'x'", "'', '1'"]
    built = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN " + row(内容=c.split(", ")[0], 类型=c.split(", ")[1], _mark="'y'") for i, c in enumerate(cases)) + " END"
    return read(spark, sf_dir, "part").select("p_partkey", normalise.is_valid(F.expr(built)).alias("valid"))


# --- columns --------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'UINT' || l_suppkey WHEN 1 THEN 'FLOAT' WHEN 2 THEN '' || l_partkey END AS described, CASE WHEN l_linenumber % 4 = 3 AND l_suppkey % 9 IN (1, 2, 4, 8) THEN CAST(8 * (l_suppkey % 9) AS INTEGER) END AS counted,
  '量' || l_partkey AS content, CASE WHEN l_linenumber % 2 = 0 THEN '' || l_linenumber END AS seq, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus WHEN l_linenumber % 3 = 1 THEN l_returnflag END AS remark, l_linestatus AS found FROM lineitem""")
def column_finders(spark, sf_dir):
    """Type, bits by length, content, number, remark, and a search both ways."""
    kind = "CASE l_linenumber % 4 WHEN 0 THEN 'UINT' || l_suppkey WHEN 1 THEN '—' END"
    r = row(序号="CASE WHEN l_linenumber % 2 = 0 THEN ' ' || l_linenumber END", 字节长类型="'无'", 转换类型="CASE l_linenumber % 4 WHEN 1 THEN 'FLOAT' ELSE '-' END", 数据类型=kind, MY_TYPE="CASE WHEN l_linenumber % 4 = 2 THEN l_partkey END", 字节数="l_suppkey % 9", 信号名称="'—'", 数据含义="'量' || l_partkey", 说明="CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus END", 数据处理方法="CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE '' END", 长状态="l_linestatus")
    d = spread(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.expr(r).alias("r"))
    told = lambda c: {"described": columns.described_type(c), "bits": columns.bits_of_length(c), "content": columns.content(c), "seq": columns.sequence_number(c), "remark": columns.remark(c), "found": columns.both_ways(c, ["状态", "长状态的说法"])}
    d = columns.by_header(d, "r", told).withColumn("counted", F.when(F.col("described").isNull(), F.col("bits")))
    return d.select("l_orderkey", "l_linenumber", "described", "counted", "content", "seq", "remark", "found")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' || o_custkey WHEN 2 THEN 'a' END AS source, CASE o_orderkey % 4 WHEN 0 THEN 'b→c' WHEN 1 THEN 'b-c' WHEN 2 THEN 'b' END AS target FROM orders""")
def route_split(spark, sf_dir):
    """Source and target, cut at the first arrow, else at an `è`, else at a hyphen; entities, tags and odd signs go."""
    told = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '<b>' || o_orderpriority || '</b>→b→c' WHEN 1 THEN o_custkey || '&egrave;b-c' WHEN 2 THEN ' a - b§' ELSE '→x' END")
    d = read(spark, sf_dir, "orders").select("o_orderkey", told.alias("t"))
    d = d.withColumn("r", text.route(F.when(F.col("o_orderkey") % 4 == 0, F.replace("t", F.lit("-"), F.lit("_"))).otherwise(F.replace("t", F.lit("&egrave;"), F.lit("è")))))
    return d.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.expr("replace(r.source, '_', '-')")).otherwise(F.col("r.source")).alias("source"), F.col("r.target").alias("target"))


@query("""SELECT p_partkey, 'a & "' || p_brand || ' → 中（' AS plain, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AS related FROM part""")
def cell_cleaning(spark, sf_dir):
    """Cells without tags, entities and odd signs; names that are related."""
    b = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_brand || '。' || p_size WHEN 1 THEN '某量值名' ELSE '某' END")
    a = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_brand || '12.' WHEN 1 THEN '某量值名称3' ELSE '某量值名称3' END")
    a, b = (F.regexp_replace(x, "#", "号") for x in (a, b))
    return read(spark, sf_dir, "part").select("p_partkey", text.allowed(F.concat(F.lit(" <i>a</i> &amp;&lt;b&gt; &quot;"), "p_brand", F.lit("§ → 中（ "))).alias("plain"), text.related(a, b).alias("related"))


# --- units, remarks, ranges -----------------------------------------------------------------------------------------

_UNIT_TEXT = "CASE p_partkey % 10 WHEN 0 THEN p_size || ' ms' WHEN 1 THEN '电压 ' || p_size || 'mV' WHEN 2 THEN '角 ' || p_size || '°' WHEN 3 THEN '占 ' || p_size || '%' WHEN 4 THEN 'LSB 是 ' || p_size || '%' WHEN 5 THEN '速度 ' || p_size || 'km' WHEN 6 THEN p_size || ' Hz' WHEN 7 THEN 'in HZ ' || p_size WHEN 8 THEN repeat('长', 201) || ' ms' ELSE p_name || '温度 (摄氏度)' END"


@query(f"""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'ms' WHEN 2 THEN '°' WHEN 3 THEN '%' WHEN 5 THEN '度' WHEN 6 THEN 'Hz' WHEN 7 THEN 'HZ' WHEN 9 THEN '度' END AS unit, CASE p_partkey % 10 WHEN 9 THEN '℃' END AS named,
  CASE p_partkey % 10 WHEN 0 THEN 'ms' WHEN 2 THEN '°' WHEN 3 THEN '%' WHEN 4 THEN '%' WHEN 6 THEN 'Hz' WHEN 7 THEN 'Hz' WHEN 1 THEN NULL WHEN 5 THEN NULL WHEN 8 THEN 'ms' WHEN 9 THEN '℃' END AS exported, CASE WHEN p_partkey % 10 IN (1, 5) THEN NULL ELSE 'extracted' END AS source FROM part""")
def unit_extract(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("p_partkey", F.expr(_UNIT_TEXT).alias("t"))
    d = d.withColumn("e", units.exported(F.array(F.struct(F.lit("单位").alias("key"), F.lit("无").alias("val")), F.struct(F.lit("说明").alias("key"), F.col("t").alias("val")))))
    return d.select("p_partkey", units.extracted(F.col("t")).alias("unit"), units.in_brackets(F.col("t")).alias("named"), F.col("e.unit").alias("exported"), F.col("e.source").alias("source"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'LSB=' || p_size WHEN 1 THEN 'ms' WHEN 2 THEN 'V' WHEN 3 THEN '' ELSE '—' END AS unit, CASE p_partkey % 5 WHEN 0 THEN 'from_process_method' WHEN 2 THEN 'extracted' ELSE 'original' END AS source,
  CASE p_partkey % 5 WHEN 0 THEN '某' || p_brand WHEN 1 THEN '计数' WHEN 2 THEN '伏 V' WHEN 3 THEN '' ELSE '某' END AS remark FROM part""")
def unit_compatible(spark, sf_dir):
    r = row(数据处理方法="CASE p_partkey % 5 WHEN 0 THEN 'LSB=' || p_size ELSE '无' END", 单位="CASE p_partkey % 5 WHEN 0 THEN 'ms' WHEN 1 THEN ' ms' WHEN 4 THEN '—' ELSE '' END", 备注="CASE p_partkey % 5 WHEN 0 THEN 'LSB=' || p_size || '，某' || p_brand || '。32位整型数' WHEN 1 THEN '计数' WHEN 2 THEN '伏 V' WHEN 3 THEN '以上电为零点' ELSE '某' END")
    d = read(spark, sf_dir, "part").select("p_partkey", F.expr(r).alias("r")).withColumn("u", units.compatible(F.col("r")))
    return d.select("p_partkey", F.col("u.unit").alias("unit"), F.col("u.source").alias("source"), F.coalesce(remarks.compatible(F.col("r")), F.lit("")).alias("remark"))


_REMARK = "CASE p_partkey % 9 WHEN 0 THEN '0~' || p_size || '0，单位 ：V' WHEN 1 THEN '范围 -40~' || p_size || '1，乘以 0.5，工作温度' WHEN 2 THEN '{0x1, ' || p_size || '}；电压 (mV)，某' WHEN 3 THEN '0:关；' || p_size || ':开' WHEN 4 THEN 'LSB=' || p_size || 'ms 除以 4+' || p_size WHEN 5 THEN '(X/2^12)×' || p_size || ' 温度 (摄氏度)' WHEN 6 THEN '某' WHEN 7 THEN '计数' || p_brand ELSE '取值范围：' || p_size || '~0x1F' END"


@query("""SELECT p_partkey, CASE n WHEN 0 THEN '[0,' || s || '0]' WHEN 1 THEN '[-40,' || s || '1]' WHEN 2 THEN '{0x1, ' || s || '}' WHEN 3 THEN '{0, ' || s || '}' WHEN 8 THEN '[' || s || ',0x1F]' END AS value_range,
  CASE n WHEN 0 THEN 'V' WHEN 2 THEN 'mV' WHEN 4 THEN s || 'ms' WHEN 5 THEN '℃' END AS unit, CASE n WHEN 1 THEN '乘以0.5' WHEN 4 THEN '除以4+' || s WHEN 5 THEN '(X/2^12)×' || s END AS formula,
  CASE n WHEN 1 THEN '范围 ，，工作温度' WHEN 2 THEN '电压 某' WHEN 3 THEN '0:关；' || s || ':开' WHEN 5 THEN '温度 (摄氏度)' WHEN 6 THEN '某' WHEN 7 THEN '计数' || p_brand WHEN 8 THEN '取值范围：' END AS rest
FROM (SELECT *, p_partkey % 9 AS n, '' || p_size AS s FROM part)""")
def remark_split(spark, sf_dir):
    d = read(spark, sf_dir, "part").select("p_partkey", F.expr(_REMARK).alias("t"))
    return d.select("p_partkey", remarks.split(F.col("t")).alias("s")).select("p_partkey", "s.*")


@query("""SELECT p_partkey, CASE n WHEN 0 THEN '[0,' || s || ']' WHEN 1 THEN '{1, ' || s || '}' WHEN 2 THEN '{0x1, 0x2}' WHEN 3 THEN '[5,' || s || ']' END AS told,
  CASE n WHEN 0 THEN '[0,' || s || ']' WHEN 1 THEN '{1, ' || s || '}' WHEN 2 THEN '{0x1, 0x2}' WHEN 3 THEN '[5,' || s || ']' WHEN 4 THEN '[0,0xF' || s || ']' WHEN 5 THEN '[0,' || s || ']' WHEN 6 THEN '[1,9]' END AS exported, CASE WHEN n < 4 THEN 'original' WHEN n < 6 THEN 'extracted' WHEN n = 6 THEN 'original' END AS source
FROM (SELECT *, p_partkey % 8 AS n, '' || p_size AS s FROM part)""")
def range_sources(spark, sf_dir):
    """A row's range: its column, then remarks by one set of forms, then, for an export, by another."""
    r = row(值域="CASE p_partkey % 8 WHEN 0 THEN '0~' || p_size ELSE '—' END", 区间="CASE p_partkey % 8 WHEN 6 THEN '1~9' END", 备注="CASE p_partkey % 8 WHEN 1 THEN '为{1,' || p_size || '}' WHEN 2 THEN '0x1:a 0x2:b' WHEN 3 THEN '取值范围 ：5~' || p_size WHEN 4 THEN '用0~0xF' || p_size || '表示' WHEN 5 THEN '某\n0~' || p_size ELSE 'LSB=1ms' END")
    d = read(spark, sf_dir, "part").select("p_partkey", F.expr(r).alias("r")).withColumn("told", remarks.told_range(F.col("r")))
    d = d.withColumn("e", export.told_range(F.col("r"), F.col("told")))
    return d.select("p_partkey", "told", F.col("e.value").alias("exported"), F.col("e.source").alias("source"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN '任意' || l_partkey WHEN 1 THEN '乘以' || l_partkey || '000' WHEN 2 THEN '除以 ' || l_partkey || '000' END AS formula FROM lineitem""")
def formula_source(spark, sf_dir):
    """Where a row's conversion is described: the formula column as it is, then conversion, then processing."""
    r = row(转换公式="CASE l_linenumber % 6 WHEN 0 THEN '任意' || l_partkey ELSE '—' END", 数据转换方法="CASE l_linenumber % 6 WHEN 1 THEN '乘以' || l_partkey || '000' WHEN 3 THEN '0x1:开 0x2:关 ×2' WHEN 4 THEN '' || l_partkey END", 数据处理="CASE l_linenumber % 6 WHEN 2 THEN '除以 ' || l_partkey || '000' WHEN 5 THEN '乘以2' END", 备注="'详细说明'")
    return spread(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", remarks.described_formula(F.expr(r)).alias("formula"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'UINT16' WHEN 1 THEN 'FLOAT' END AS std_type, CAST(CASE l_linenumber % 3 WHEN 0 THEN 16 WHEN 1 THEN 32 ELSE 8 END AS INTEGER) AS bits,
  CASE l_linenumber % 3 WHEN 0 THEN '[0,' || q || ']' WHEN 1 THEN '{0, ' || q || '}' ELSE '[1,' || q || '0]' END AS value_range, CASE l_linenumber % 3 WHEN 0 THEN 'ms' WHEN 2 THEN 'V' END AS unit,
  CASE l_linenumber % 3 WHEN 0 THEN q || 'x+1' WHEN 2 THEN '0.5x+0' END AS formula FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""")
def normalised_rows(spark, sf_dir):
    """Rows normalised as a whole; of a remark that lists values only the range is taken, and it wins."""
    q = "CAST(l_quantity AS INT)"
    r = row(内容="'某'", 类型="CASE l_linenumber % 3 WHEN 0 THEN ' ushort ' WHEN 1 THEN '单精度浮点' ELSE '—' END", 字节数="CASE l_linenumber % 3 WHEN 2 THEN 1 ELSE 9 END", 值域=f"CASE l_linenumber % 3 WHEN 0 THEN '0~' || {q} WHEN 1 THEN '9~9' END", 单位="CASE l_linenumber % 3 WHEN 0 THEN 'ms' ELSE '' END", 数据处理=f"CASE l_linenumber % 3 WHEN 0 THEN '乘以 ' || {q} || '+1' END", 备注=f"CASE l_linenumber % 3 WHEN 1 THEN '0:关 {{x}} ' || {q} || ':开 乘以 3' WHEN 2 THEN '1~' || {q} || '0，单位 ：V，乘以0.5，某' ELSE '某' END".replace("{x}", "").replace("{{}}", ""))
    d = spread(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.expr(r).alias("row"))
    return normalise.normalised(d).select("l_orderkey", "l_linenumber", "std_type", "bits", "value_range", "unit", "formula")


# --- linking and export ---------------------------------------------------------------------------------------------

#: Documents made of parts: one for each brand; a port table, a table of IDs, and for each part a table of fields and one of bits.
_DOC = "p_brand"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("doc"), "p_size", F.concat(F.lit("消息"), F.col("p_partkey") % 400, F.lit("号")).alias("msg"))
    entry = lambda r: F.sort_array(F.collect_list(F.struct("p_partkey", F.expr(r).alias("r"))))
    no_meta = F.expr("cast(map() as map<string,string>)")
    heads = lambda r: F.transform(F.get("data_rows", 0), lambda e: e["key"])
    port = p.filter("p_partkey % 3 = 0").groupBy("doc").agg(entry(row(序号="p_partkey", 信息内容="msg", 信源系统码="'S' || p_size", 信源机器码="CASE WHEN p_size % 2 = 0 THEN '—' ELSE 'M' || p_partkey END", 信宿系统码="'T'", 信宿机器码="''")).alias("x")).select("doc", F.lit(0).alias("index"), F.lit("port_allocation").alias("table_type"), F.lit("端口分配表").alias("msg_name"), F.col("x.r").alias("data_rows"), no_meta.alias("meta"))
    ids = p.filter("p_partkey % 4 = 0").groupBy("doc").agg(entry(row(信息内容="msg", 消息ID="'0x' || p_partkey")).alias("x")).select("doc", F.lit(1).alias("index"), F.lit("message_id").alias("table_type"), F.lit("消息ID表").alias("msg_name"), F.col("x.r").alias("data_rows"), no_meta.alias("meta"))
    # The lines of a part are told apart and ordered by what their rows are made of; rows are made where they are.
    told = F.struct("l_orderkey", "l_linenumber", "l_suppkey", F.expr("'0~' || CAST(l_quantity AS INT)").alias("span"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set(told)).alias("x"))
    made = row(序号="x.l_orderkey", 内容="'量' || x.l_suppkey", 类型="CASE WHEN x.l_linenumber = 7 THEN '见表B.1' ELSE 'ushort' END", 字节数="CASE WHEN x.l_linenumber = 7 THEN 4 ELSE 2 END", 值域="x.span", 备注="CASE WHEN x.l_linenumber % 2 = 0 THEN '单位 ms' ELSE '—' END")
    own = p.join(lines, F.col("l_partkey") == F.col("p_partkey")).select("doc", (10 + 2 * F.col("p_partkey")).cast("int").alias("index"), F.lit("field_def").alias("table_type"), F.col("msg").alias("msg_name"), F.expr(f"transform(x, x -> {made})").alias("data_rows"), F.when(F.col("p_partkey") % 5 == 0, F.create_map(F.lit("ID"), F.lit("own"))).otherwise(no_meta).alias("meta"))
    bits = p.filter("p_partkey % 2 = 0").select("doc", (11 + 2 * F.col("p_partkey")).cast("int").alias("index"), F.lit("bit_def").alias("table_type"), F.lit("位").alias("msg_name"), F.expr(f"array({row(位号=chr(39) + 'D7' + chr(39), 状态参数=chr(39) + '甲' + chr(39))}, {row(位号=chr(39) + 'D6~D' + chr(39) + ' || p_size % 7', 状态参数=chr(39) + '乙' + chr(39) + ' || p_size')})").alias("data_rows"), no_meta.alias("meta"))
    t = port.unionByName(ids).unionByName(own).unionByName(bits)
    return staged(t.withColumn("headers", heads("data_rows")).withColumn("is_auxiliary", F.col("table_type") != "field_def"))


_LINKED = """
WITH p AS (SELECT p_partkey, p_brand AS doc, p_size, '消息' || (p_partkey % 400) || '号' AS msg FROM part),
port AS (SELECT doc, msg, arg_max(p_partkey, p_partkey) AS k, arg_max(p_size, p_partkey) AS size FROM p WHERE p_partkey % 3 = 0 GROUP BY doc, msg),
ids AS (SELECT doc, msg, max(p_partkey) AS id FROM p WHERE p_partkey % 4 = 0 GROUP BY doc, msg),
t AS (SELECT p.*, 10 + 2 * p_partkey AS idx, port.size, port.k, ids.id FROM p LEFT JOIN port USING (doc, msg) LEFT JOIN ids USING (doc, msg) WHERE p_partkey IN (SELECT l_partkey FROM lineitem))
"""


@query(_LINKED + """SELECT doc, CAST(idx AS INTEGER) AS index, msg AS msg_name, 'S' || size AS system, CASE WHEN size % 2 = 1 THEN 'M' || k END AS machine, CASE WHEN p_partkey % 5 = 0 THEN 'own' END AS own_id,
  CASE WHEN p_partkey % 5 <> 0 AND id IS NOT NULL THEN '0x' || id END AS message_id, CASE WHEN p_partkey % 5 = 0 THEN 'original' WHEN id IS NOT NULL THEN 'linked' END AS id_source FROM t""")
def link_meta(spark, sf_dir):
    """Codes and IDs of each table of fields from the port and ID tables of its document; what is there stays."""
    told = lambda c, k: F.try_element_at(c, F.lit(k))
    f = link.linked(_tables(spark, sf_dir))
    source = F.coalesce(told("meta_sources", "ID"), told("meta_sources", "消息ID"))
    return f.select("doc", "index", "msg_name", told("meta", "信源系统码").alias("system"), told("meta", "信源机器码").alias("machine"), told("meta", "ID").alias("own_id"), told("meta", "消息ID").alias("message_id"), source.alias("id_source"))


_ROWS = """, l AS (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
r AS (SELECT t.doc, t.idx, t.msg, t.p_partkey, t.size, t.k, t.id, l.*, row_number() OVER (PARTITION BY doc, idx ORDER BY l_orderkey, l_linenumber, l_suppkey, '0~' || q) - 1 AS pos FROM t JOIN l ON l_partkey = p_partkey),
following AS (SELECT doc, idx, (SELECT min(p_partkey) FROM p b WHERE b.doc = t.doc AND b.p_partkey % 2 = 0 AND 11 + 2 * b.p_partkey > t.idx) AS b FROM t),
x AS (SELECT r.*, s.p_size AS bit_size, sub FROM r LEFT JOIN following USING (doc, idx) LEFT JOIN part s ON s.p_partkey = following.b, (SELECT unnest([0, 1, 2]) AS sub) WHERE sub = 0 OR (l_linenumber = 7 AND b IS NOT NULL))
"""


@query(_LINKED + _ROWS + """SELECT doc, CAST(idx AS INTEGER) AS index, CAST(pos AS INTEGER) AS "at", CAST(sub AS INTEGER) AS sub, CASE sub WHEN 0 THEN '量' || l_suppkey WHEN 1 THEN '甲' ELSE '乙' || bit_size END AS content,
  CASE WHEN sub > 0 THEN '' || (CASE sub WHEN 1 THEN 1 ELSE 6 - bit_size % 7 + 1 END) END AS bits, CASE WHEN sub > 0 THEN 'UINT32' END AS inferred FROM x""")
def bit_children(spark, sf_dir):
    """Each row of fields, and behind one that points to a table of bits the rows of the next such table."""
    cell = columns.cell
    r = link.field_rows(link.linked(_tables(spark, sf_dir)))
    return r.select("doc", "index", "at", "sub", cell(F.col("row"), "内容").alias("content"), F.when(F.col("is_bit"), cell(F.col("row"), "类型（bit）")).alias("bits"), F.col("inferred_type").alias("inferred"))


@query(_LINKED + _ROWS + """SELECT doc, CAST(idx AS INTEGER) AS index, CAST(pos AS INTEGER) AS "at", CAST(sub AS INTEGER) AS sub, CASE WHEN pos = 0 AND sub = 0 THEN msg ELSE '' END AS name,
  CASE WHEN pos = 0 AND sub = 0 THEN 'S' || size END AS system, CASE WHEN pos = 0 AND sub = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'own' WHEN id IS NOT NULL THEN '0x' || id END END AS id,
  CASE sub WHEN 0 THEN '量' || l_suppkey WHEN 1 THEN '甲' ELSE '乙' || bit_size END AS content, CASE sub WHEN 0 THEN CASE WHEN l_linenumber = 7 THEN '0' ELSE '16' END WHEN 1 THEN '1' ELSE '' || (6 - bit_size % 7 + 1) END AS bits,
  CASE WHEN sub > 0 THEN 'UINT32' WHEN l_linenumber = 7 THEN '见表B.1' ELSE 'UINT16' END AS kind, CASE WHEN sub = 0 THEN '[0,' || q || ']' END AS value_range, CASE WHEN sub = 0 AND l_linenumber % 2 = 0 THEN 'ms' END AS unit FROM x""")
def extract_rows(spark, sf_dir):
    """From parsed tables to export rows: linked, normalised, under standard names, sixteen columns."""
    known = spark.createDataFrame([("值域说明", "值域", 0.95, 0)], "source string, target string, confidence double, ord int")
    out = extract.rows_of(_tables(spark, sf_dir), known, stores.vocabulary(spark))
    return out.select("doc", "index", "at", "sub", F.col("名称").alias("name"), F.col("信源系统码").alias("system"), F.col("ID").alias("id"), F.col("内容").alias("content"), F.col("类型（bit）").alias("bits"), F.col("转换类型").alias("kind"), F.col("判读公式").alias("value_range"), F.col("单位").alias("unit"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ID' WHEN 1 THEN '信源机器码' WHEN 2 THEN '信源系统码' WHEN 4 THEN '备注' WHEN 5 THEN '子地址' END AS column_, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '' || p_size END AS content, CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_size END AS kind FROM part""")
def column_resolution(spark, sf_dir):
    """Where a meta key goes, and where a column's value comes from: its name, a mapped name, a stand-in."""
    key = F.expr("CASE p_partkey % 6 WHEN 0 THEN '信息标识' WHEN 1 THEN '信源机' WHEN 2 THEN '信源系统码' WHEN 3 THEN '发起时机' WHEN 4 THEN '备注说明' ELSE '子地址' END")
    r = F.expr(f"CASE p_partkey % 3 WHEN 0 THEN {row(内容='p_name', 参数='p_brand')} WHEN 1 THEN {row(甲='p_brand', 参数='p_size')} ELSE {row(信号名称='p_size', 类型='p_size')} END")
    r = F.concat(r, F.expr("CASE WHEN p_partkey % 2 = 0 THEN " + row(数据类型="'k' || p_size") + " ELSE " + row(说明="1") + " END"))
    d = read(spark, sf_dir, "part").select("p_partkey", key.alias("key"), F.filter(r, lambda e: e["key"] != "类型").alias("r"))
    targets = F.create_map(F.lit("甲"), F.lit("内容"))
    return d.select("p_partkey", export.meta_column(F.col("key")).alias("column_"), export.column_value(F.col("r"), "内容", targets).alias("content"), export.column_value(F.col("r"), "转换类型").alias("kind"))


@query("""SELECT doc, index, CASE WHEN index = 0 THEN '序号' WHEN index = 1 THEN '信息内容' ELSE '序号' END AS first_column, n FROM (
  SELECT p_brand AS doc, 0 AS index, count(*) FILTER (p_partkey % 3 = 0) AS n FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 1, count(*) FILTER (p_partkey % 4 = 0) FROM part GROUP BY p_brand) WHERE n > 0""")
def collected_tables(spark, sf_dir):
    """The first table of ports and of IDs of each document."""
    t = _tables(spark, sf_dir)
    found = link.first_of_kind(t, (("信源系统码", "信源机器码"),)).union(link.first_of_kind(t, (("消息ID", "消息标识"), ("信息内容",))))
    return found.select("doc", "index", F.get("headers", 0).alias("first_column"), F.size("data_rows").cast("long").alias("n"))
