"""The first generation's readings of tables: positional headers, unique rows, ordered names with gaps, older types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, first_match, without_runs

#: Older type names, what they become, their bits; in the list form a DOUBLE has 32.
TYPES = (("CHAR", "INT8", 8), ("SHORT", "INT16", 16), ("INTEGER-32", "INT32", 32), ("FLOAT", "FLOAT32", 32), ("DOUBLE", "DOUBLE64", 64))
LISTED = {"CHAR": 8, "UCHAR": 8, "SHORT": 16, "USHORT": 16, "INTERGER-32": 32, "UINTEGER-32": 32, "FLOAT": 32, "DOUBLE": 32}


def standard(c: Column) -> Column:
    """STRUCT<type, bits>: unsigned where the name starts with u and goes on; an unknown name is `Nan` with 0 bits."""
    sign = F.when(c.rlike(r"(?iU)^u\w+"), "U").otherwise("")
    known = F.coalesce(*[F.when(c.rlike(f"(?iu){old}") | c.rlike(f"(?iu){new}"), F.struct(F.concat(sign, F.lit(new)).alias("type"), F.lit(bits).alias("bits"))) for old, new, bits in TYPES])
    return F.coalesce(known, F.struct(F.lit("Nan").alias("type"), F.lit(0).alias("bits")))


def listed_bits(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LISTED.items() for x in kv]), c), F.lit(0))


def bus_parts(c: Column) -> Column:
    """STRUCT<source, target, sub, length> of `BC RT2-SA1-7`; the side that isn't the controller is as it stands, a mode code has length 0."""
    starts = c.startswith("BC")
    rest = F.split(F.when(starts, F.get(F.split(c, "BC"), 1)).otherwise(F.get(F.split(c, "BC"), 0)), "-")
    code, last = F.get(rest, 0), F.get(rest, 2)
    length = F.when(last.contains("模式码"), "0").otherwise(first_match(last, "[0-9]+"))
    return F.struct(F.when(starts, "BC").otherwise(code).alias("source"), F.when(starts, code).otherwise("BC").alias("target"), F.substring(F.get(rest, 1), F.lit(3), F.lit(1000)).alias("sub"), length.alias("length"))


def row_cells(grid: Column, r: Column) -> Column:
    """A row without repeats side by side."""
    return without_runs(F.get(grid, r))


def column_cells(grid: Column, c: Column) -> Column:
    return F.transform(grid, lambda row: F.get(row, c))


def picked(row: Column, indices: Column) -> Column:
    """The cells at these indices, in their order."""
    return F.transform(indices, lambda i: F.get(row, i))


def unique_rows(cells: DataFrame, keys: list[str], row: str, value: str) -> DataFrame:
    """The first row of each value of a column: what a vertical merge shows once."""
    return cells.groupBy(*keys, value).agg(F.min(row).alias(row))


def two_levels(grid: Column, info_row: Column, header_row: Column, keys: Column, header: Column) -> Column:
    """STRUCT<name, parent> of a table whose info row reads key, name, key, parent and whose header row has all of a header; else null."""
    info, head = without_runs(F.get(grid, info_row)), without_runs(F.get(grid, header_row))
    fits = (F.size(info) >= 4) & (F.get(info, 0) == F.get(keys, 0)) & (F.get(info, 2) == F.get(keys, 1)) & (F.size(F.array_except(header, head)) == 0)
    return F.when(fits, F.struct(F.get(info, 1).alias("name"), F.get(info, 3).alias("parent")))


def ordered_difference(a: Column, b: Column) -> Column:
    """Indices of the first list's elements that the second lacks; none where the first is shorter."""
    missing = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~F.array_contains(b, F.get(a, i)))
    return F.when((F.size(a) > 0) & (F.size(a) >= F.size(b)), missing).otherwise(F.expr("cast(array() as array<int>)"))


def data_rows(rows: DataFrame, keys: list[str], order: str, first: str, text: str) -> DataFrame:
    """Rows without notes, and without a last row of a checksum."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) == 1
    return rows.withColumn("_last", last).filter(~F.col(first).contains("注") & ~(F.col("_last") & F.col(text).contains("CRC"))).drop("_last")


def reordered(names: DataFrame, rows: DataFrame, name: str, order: str) -> DataFrame:
    """Rows in the order of names; rows of other names go, and between the first and last name found one without a row stays as a gap."""
    found = names.join(rows, name, "left")
    has = found.select(order, F.coalesce(*[F.col(c).isNotNull() for c in rows.columns if c != name]).alias("_h"))
    ends = has.filter("_h").agg(F.min(order).alias("_a"), F.max(order).alias("_z"))
    return found.crossJoin(F.broadcast(ends)).filter(F.col(order).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")  # ends: one row


def framed(rows: DataFrame, heads: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows beside their message's head, which stands on the first row only; messages without a head go."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return rows.join(heads.select(*keys, *columns), keys).withColumn("_f", first).withColumns({c: F.when(F.col("_f"), F.col(c)).otherwise("") for c in columns}).drop("_f")


__all__ = ["clean", "standard"]
