"""Stores of the application as tables: configuration, vocabulary, mappings, templates, history, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean

#: The vocabulary of an application without configuration; the extensions of files that are taken.
STANDARD = "序号 参数 内容 信号名称 数据类型 类型 长度 字节 单位 备注 值域 信源 信宿 信息内容 消息ID 接口名称 时间戳 转换类型".split()
EXTENSIONS = (".doc", ".docx", ".xlsx", ".xls", ".csv")
KB = "source string, target string, table_id string, confidence double, hits long, created_at string"
FIELDS = "id string, name string"
#: Keys of a task record that aren't kept, and the length of a history.
BULKY, KEPT = ("raw_tables", "processed_tables"), 50


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file of one value; a missing file has none, a damaged one none either."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)


def read_fields(spark: SparkSession, path: str, key: str = "protocolFields") -> DataFrame:
    """id, name, ord of a configuration of fields: a list of them, or an object with a list under a key."""
    flat = _json(spark, path, f"{FIELDS}, {key} array<struct<id:string,name:string>>")
    one = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.array(F.struct("id", "name")))
    # A list's elements keep their order within the file, which is read by one task.
    rows = flat.select(F.monotonically_increasing_id().alias("_m"), F.posexplode(one).alias("_p", "f"))
    return rows.filter("f.name is not null").select("f.id", "f.name", (F.col("_m") * 100_000 + F.col("_p")).alias("ord"))


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """source, target, table_id, confidence, hits, created_at, ord of a knowledge base."""
    file = _json(spark, path, f"mappings array<struct<{KB.replace(' ', ':').replace(',:', ',')}>>")
    return file.filter("mappings is not null").select(F.posexplode("mappings").alias("ord", "m")).select("m.*", "ord")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """original, target, confidence, created_at of a store of mappings by original name."""
    file = spark.read.option("wholetext", True).text(path) if _exists(spark, path) else spark.createDataFrame([], "value string")
    return file.select(F.explode(F.from_json("value", "map<string,struct<target:string,confidence:double,created_at:string>>")).alias("original", "m")).select("original", "m.*")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p))


def vocabulary(spark: SparkSession, *fields: DataFrame) -> DataFrame:
    """word, ord: the names of all configurations, each once, in their order; the standard names if there are none."""
    words = None
    for k, f in enumerate(fields):
        part = f.select(F.col("name").alias("word"), F.lit(k).alias("k"), "ord")
        words = part if words is None else words.union(part)
    standard = spark.createDataFrame([(w, 0, i) for i, w in enumerate(STANDARD)], "word string, k int, ord long")
    if words is not None and not words.filter("word is not null").isEmpty():
        standard = words.filter("word is not null")
    least = standard.groupBy("word").agg(F.min(F.struct("k", "ord")).alias("at"))
    return least.select("word", (F.col("at.k") * (1 << 40) + F.col("at.ord")).alias("ord"))


def accepted_file(name: Column) -> Column:
    """An extension of the list, without regard to case; names of temporary files aren't taken."""
    return ~name.rlike(r"(^|/)~") & F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)).isin(*EXTENSIONS)


def protocol_file(name: Column) -> Column:
    return name.contains("协议") & ~name.contains("~")


def sheet_name(name: Column) -> Column:
    """A name without the words that all have, at most twenty characters of a long one."""
    short = F.replace(name, F.lit("通信协议"), F.lit(""))
    return F.when(F.length(short) > 21, F.substring(short, 1, 20)).otherwise(short)


def stamped(at: Column) -> Column:
    return F.concat(F.lit("协议_"), F.date_format(at, "yyyyMMddHHmmss"), F.lit(".xlsx"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key: of each the newest, where the key first stood."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    at = F.struct("_src", order)
    others = [c for c in old.columns if c not in (key, order)]
    return both.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("_v"), F.min(at).alias("_at")).select(key, *[F.col(f"_v.{c}").alias(c) for c in others], F.col("_at._src").alias("new"), F.col(f"_at.{order}").alias(order))


def deleted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def applied(mappings: DataFrame, new: DataFrame, knowledge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings with the new ones in the place of those of one original, and the knowledge base that has learnt them.

    mappings, new: original, target, confidence, created_at, ord. knowledge: source, target, table_id, confidence, hits, ord.
    """
    from .knowledge import folded

    learnt = new.select(F.col("original").alias("source"), "target", F.lit("default").alias("table_id"), "confidence", F.lit(1).cast("long").alias("hits"), (F.col("ord") + (1 << 40)).alias("ord"))
    return upserted(mappings, new, "original", "ord"), folded(knowledge.select(learnt.columns).union(learnt), "ord")


def checked(names: DataFrame, name: str, confidence: str) -> DataFrame:
    """Adds `error`: a missing or overlong name, or a confidence that isn't in 0 to 1; null where all is well."""
    n, c = clean(F.col(name)), F.col(confidence)
    return names.withColumn("error", F.when(n.isNull() | (n == ""), "name is missing").when(F.length(n) > 100, "name is over 100 characters").when(~F.coalesce(c.between(0, 1), F.lit(False)), "confidence is not in 0 to 1"))


def page_bounds(number: int, size: int) -> tuple[int, int]:
    """Offset and length of a page."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("a page is 1 or more, of 1 to 100 rows")
    return (number - 1) * size, size


def expected(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """task, pos, name: the names of requested field ids in the order of the request; unknown ids are left out, of one id the first counts."""
    first = fields.groupBy(F.col("id").cast("string").alias("_id")).agg(F.min_by("name", "ord").alias("name"))
    return requests.withColumn("_id", F.col("id").cast("string")).join(first, "_id").select("task", "pos", "name")


def split_matched(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    return matches.filter("matched is not null"), matches.filter("matched is null")


def per_target(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("target").agg(F.count("*").alias("n"))


def toggled(chosen: Column, shown: Column) -> Column:
    """Select all that is shown, or none of it if all of it is chosen."""
    return F.when(F.size(F.array_except(shown, chosen)) == 0, F.array_except(chosen, shown)).otherwise(F.array_union(chosen, shown))


def history(tasks: DataFrame, created: str, tie: str, kept: int = KEPT) -> DataFrame:
    """The newest tasks, without bulky columns."""
    return tasks.orderBy(F.desc(created), tie).limit(kept).drop(*BULKY)


def preview(tables: DataFrame) -> DataFrame:
    """doc, index, columns of the document's first table, and the first row of each table."""
    first = tables.groupBy("doc").agg(F.min_by("headers", "index").alias("columns"))
    return tables.select("doc", "index", F.get("data_rows", 0).alias("first_row")).join(first, "doc")


def consistency(compared: DataFrame, mismatches: str = "mismatches", side: str = "side") -> DataFrame:
    """Common keys, those with a difference, and the share of those without."""
    both = compared.filter(F.col(side) == "both")
    out = both.agg(F.count("*").alias("common"), F.count_if(F.col(mismatches) > 0).alias("different"))
    return out.withColumn("rate", F.try_divide(F.col("common") - F.col("different"), F.col("common")))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def appended(frames: list[DataFrame]) -> DataFrame:
    """Frames one after another, with all columns of any."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def knowledge_query(knowledge: DataFrame, sources: DataFrame, scored: DataFrame, most: int = 10) -> DataFrame:
    """source, rank, target, confidence, match_type, hits: the best of each target for each source asked for.

    An equal name but for case counts 1; another is as sure as 0.9 times its likeness, from more than 0.6 on. knowledge: source,
    target, hits, ord. scored: field, word, similarity of the lower-cased names that may be alike.
    """
    kb = knowledge.select(F.lower("source").alias("word"), "target", "hits", "ord").filter(F.coalesce(F.col("target") != "", F.lit(False)))
    asked = sources.select("source", F.lower("source").alias("field"))
    exact = asked.join(kb, F.col("field") == F.col("word")).select("source", "target", F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_type"), "hits", "ord")
    near = scored.filter((F.col("field") != F.col("word")) & (F.col("similarity") > 0.6)).select("field", "word", "similarity")
    fuzzy = asked.join(near, "field").join(kb, "word").select("source", "target", F.round(F.col("similarity") * 0.9, 3).alias("confidence"), F.lit("fuzzy").alias("match_type"), "hits", "ord")
    order = [F.desc("confidence"), F.desc("hits"), "ord"]
    best = exact.union(fuzzy).withColumn("_r", F.row_number().over(Window.partitionBy("source", "target").orderBy(*order))).filter("_r = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("rank") <= most).select("source", "rank", "target", "confidence", "match_type", "hits")


def record(detected: Column, file: Column, at: Column) -> Column:
    """STRUCT<file, at, table_count, tables>: what a recognition leaves, with previews of its tables."""
    return F.struct(file.alias("file"), at.alias("at"), F.size(detected).alias("table_count"), detected.alias("tables"))
