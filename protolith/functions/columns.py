"""What the columns of a data row are for. A row is ARRAY<STRUCT<key, val>>, in the order of its columns.

Such a row is asked for its columns by tests of their names. `by_header` puts a row of another kind in its place: one
whose list of names was tested once, for all rows that have it, and that is read by place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

from . import types
from .text import clean, let

#: What a cell says that says nothing.
EMPTY = ("", "—", "-")
#: Names of the columns that hold names, types, lengths, remarks.
CONTENT = ("内容", "数据含义", "字段", "参数", "信号名称", "名称")
TYPE = ("数据类型", "数据格式", "转换类型", "类型")
LENGTHS = ("字节数", "字节", "数据长度", "数据段长度", "长度")
REMARK = ("备注", "说明")


#: Lists of names that are broadcast with the places of their columns; with more, each row's names are tested.
MOST_HEADERS = 20_000


def entries(row, fits: Callable[[Column], Column]) -> Column:
    """The columns whose names fit, in their order."""
    return F.filter(row, lambda e: fits(e["key"])) if isinstance(row, Column) else row.entries(lambda k: F.when(fits(k), 0))


def ranked(row, rank: Callable[[Column], Column]) -> Column:
    """The columns whose names have a rank, lowest first, then in their order."""
    return _at(row, _ranks(F.transform(row, lambda e: e["key"]), rank)) if isinstance(row, Column) else row.entries(rank)


def _ranks(keys: Column, rank) -> Column:
    told = F.transform(keys, lambda k, i: F.struct(rank(k).alias("rank"), i.alias("i")))
    return F.transform(F.array_sort(F.filter(told, lambda x: x["rank"].isNotNull())), lambda x: x["i"])


def _at(row: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(row, i))


class _Asked:
    """Stands for a row, and keeps what is asked of its names."""

    def __init__(self):
        self.ranks: list = []

    def entries(self, rank) -> Column:
        self.ranks.append(rank)
        return F.expr("cast(null as array<struct<key:string,val:string>>)")


class _Told:
    """Stands for a row whose places are told, in the order in which they were asked for."""

    def __init__(self, row: Column, places: Column):
        self.row, self.places, self.k = row, places, 0

    def entries(self, rank) -> Column:
        self.k += 1
        return _at(self.row, self.places.getField(f"p{self.k - 1}"))


def lists_of(df: DataFrame, row: str) -> DataFrame:
    """_heads: the distinct lists of names of rows."""
    return df.select(F.transform(row, lambda e: e["key"]).alias("_heads")).distinct().filter("_heads is not null")


def by_header(df: DataFrame, row: str, build: Callable[[object], dict[str, Column]], lists: DataFrame | None = None) -> DataFrame:
    """Adds the columns that `build` makes of a row. The names are tested once for each distinct list of them.

    build asks the row it is given through `entries`, `ranked` and what this module and others make of them, in the same
    order each time. lists: what `lists_of` gives, or more; without it df is read twice: stage what is costly.
    """
    asked = _Asked()
    build(asked)
    heads = F.transform(row, lambda e: e["key"])
    places = F.struct(*[_ranks(F.col("_heads"), r).alias(f"p{k}") for k, r in enumerate(asked.ranks)])
    told = staged((lists_of(df, row) if lists is None else lists).select("_heads", places.alias("_places")))
    if told.count() > MOST_HEADERS:
        return df.withColumns(build(F.col(row)))
    d = df.withColumn("_heads", heads).join(F.broadcast(told), "_heads", "left")
    return d.select(*df.columns, *[v.alias(k) for k, v in build(_Told(F.col(row), F.col("_places"))).items()])


def asked_of(df: DataFrame, row: str, build: Callable[[object], dict[str, Column]], name: str, lists: DataFrame | None = None) -> DataFrame:
    """Adds the part of a row that `build` asks for: its columns, in their order, whose stripped names one of the tests fits.

    What `build` makes of the stripped part it would make of the whole stripped row. lists: as for `by_header`.
    """
    asked = _Asked()
    build(asked)
    wanted = lambda k: reduce(or_, [r(k).isNotNull() for r in asked.ranks])
    heads = F.transform(row, lambda e: e["key"])
    places = F.array_compact(F.transform(F.transform("_heads", clean), lambda k, i: F.when(wanted(k), i)))
    told = staged((lists_of(df, row) if lists is None else lists).select("_heads", places.alias("_places")))
    if told.count() > MOST_HEADERS:
        return df.withColumn(name, F.filter(row, lambda e: wanted(clean(e["key"]))))
    d = df.withColumn("_heads", heads).join(F.broadcast(told), "_heads", "left")
    return d.select(*df.columns, _at(F.col(row), F.col("_places")).alias(name))


def any_of(key: Column, words) -> Column:
    return reduce(or_, [key.contains(w) for w in words])


def says(value: Column, *more: str) -> Column:
    """A cell that says something: not null, not empty, no dash."""
    return F.coalesce(~clean(value).isin(*EMPTY, *more), F.lit(False))


def cell(row: Column, name: str) -> Column:
    """The first cell of the column of just this name, as it is."""
    return F.get(entries(row, lambda k: k == name), 0)["val"]


def stripped(row: Column) -> Column:
    return F.transform(row, lambda e: F.struct(clean(e["key"]).alias("key"), clean(e["val"]).alias("val")))


def values(row: Column, fits, *more: str) -> Column:
    """The cells, in order, of the columns that fit by name and say something."""
    return F.transform(F.filter(entries(row, fits), lambda e: says(e["val"], *more)), lambda e: clean(e["val"]))


def first(row: Column, fits, *more: str) -> Column:
    return F.get(values(row, fits, *more), 0)


def both_ways(row: Column, candidates) -> Column:
    """The first cell that says something of a column whose name holds a candidate, or is held by one."""
    return first(row, lambda k: reduce(or_, [k.contains(c) | F.lit(c).contains(k) for c in candidates]))


def content(row: Column) -> Column:
    return first(row, lambda k: any_of(k, CONTENT))


def sequence_number(row: Column) -> Column:
    return first(row, lambda k: k.contains("序号") | (k == "NO"))


def remark(row: Column) -> Column:
    """The remark as it stands; a column on processing stands in for one."""
    return F.coalesce(first(row, lambda k: any_of(k, (*REMARK, "数据来源"))), first(row, lambda k: k.contains("数据处理方法")))


def described_type(row: Column) -> Column:
    """The cell of the column that tells a type, by the strongest name; columns of lengths are none."""

    def rank(k):
        named = F.coalesce(*[F.when(k.contains(t), F.lit(i)) for i, t in enumerate(TYPE)])
        other = F.when(F.upper(k).contains("TYPE") & ~any_of(k, ("字节", "长度")), F.lit(len(TYPE)))
        return F.coalesce(F.when(~k.contains("长") & ~k.contains("字节"), named), other)

    return F.get(F.filter(F.transform(ranked(row, rank), lambda e: clean(e["val"])), lambda v: F.coalesce(~v.isin(*EMPTY), F.lit(False))), 0)


def bits_of_length(row: Column) -> Column:
    """Bits of the first column of a length that holds digits only, if they are a type's: 8, 16, 32 or 64."""
    counted = F.get(F.filter(values(row, lambda k: any_of(k, LENGTHS) & ~any_of(k, ("类型", "数据类型", "数据格式"))), lambda v: v.rlike("^[0-9]+$")), 0)
    bits = counted.try_cast("int") * 8
    return F.when(bits.isin(8, 16, 32, 64), bits)


def standard_type(row: Column) -> Column:
    """STRUCT<std_type, bits, type_status>; with a length alone only the bits are told."""
    by_length = F.struct(F.lit(None).cast("string").alias("std_type"), bits_of_length(row).alias("bits"), F.lit(None).cast("string").alias("type_status"))
    return let(described_type(row), lambda t: F.when(t.isNotNull(), types.canonical(t)).otherwise(by_length))


def names(rows: Column) -> Column:
    """All column names of rows, each once."""
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda e: e["key"]))))


def last_wins(row: Column) -> Column:
    """One cell for each name: where the first stands, with what the last says."""
    keys = lambda r: F.array_distinct(F.transform(r, lambda e: e["key"]))
    return let(row, lambda r: F.transform(keys(r), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(r, lambda e: e["key"] == k), -1)["val"].alias("val"))))


def placed(heads: Column, targets: Column) -> Column:
    """ARRAY<STRUCT<key, place>>: for each standard name of a list of names, where the first stands, the place of the last."""
    named = F.transform(heads, lambda k, i: F.struct(F.coalesce(F.try_element_at(targets, k), k).alias("key"), i.alias("place")))
    return F.transform(F.array_distinct(F.transform(named, lambda e: e["key"])), lambda k: F.element_at(F.filter(named, lambda e: e["key"] == k), -1))


def renamed(row: Column, targets: Column) -> Column:
    """Columns under their standard names (MAP<name, target>), one for each; a name without a target stays."""
    return last_wins(F.transform(row, lambda e: F.struct(F.coalesce(F.try_element_at(targets, e["key"]), e["key"]).alias("key"), e["val"].alias("val"))))
