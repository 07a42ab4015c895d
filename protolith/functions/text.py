"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression used twice is computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_first(s: Column, part: Column) -> Column:
    """The text without the first occurrence of a part, which is no pattern."""
    at = F.instr(s, part)
    return F.when((F.length(part) > 0) & (at > 0), F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + F.length(part), F.length(s)))).otherwise(s)


def first_match(s: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean(c: Column) -> Column:
    """Strips all Unicode white space; `trim` alone strips blanks only."""
    return F.trim(c, F.lit(WHITE))


def fields(c: Column) -> Column:
    """Field names of a line of text: split on commas, semicolons, bars, tabs and line ends, stripped, none empty."""
    return F.filter(F.transform(F.split(c, r"[,，;；\n\t|]"), clean), lambda x: x != "")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def stem(c: Column) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def family(name: Column) -> Column:
    """Protocol family by file name: bus 0, serial 1, network 2, else -1."""
    return F.when(name.contains("总线"), 0).when(name.contains("串行"), 1).when(name.contains("网络"), 2).otherwise(-1)


def without_runs(a: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def headers(a: Column) -> Column:
    """Header cells without runs; an empty cell is kept under a name with its index."""
    named = F.transform(a, lambda x, i: F.struct(i.alias("idx"), F.when(x == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(x).alias("name")))
    return let(named, lambda n: F.filter(n, lambda x, i: (i == 0) | (x["name"] != F.get(n, i - 1)["name"])))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def contains_all(row: Column, base: Column) -> Column:
    return F.size(F.array_except(base, row)) == 0


def allowed(c: Column) -> Column:
    """Printable ASCII, CJK ideographs and the signs of routes and names; common entities decoded, tags dropped, stripped."""
    plain = c
    for entity, sign in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return clean(F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", ""), r"[^ -~\x{4e00}-\x{9fff}→è：（）【】、，。]", ""))


#: Entities in cells of documents, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&rarr;", "→"), ("&egrave;", "è"), ("&amp;", "&"))


def han_only(c: Column) -> Column:
    """CJK ideographs and brackets, brackets in full width."""
    return F.translate(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}()（）]", ""), "()", "（）")


def route(c: Column) -> Column:
    """STRUCT<source, target> of a text like `a→b`, cut at the first arrow, `è` or hyphen that there is; null if a side is empty."""
    both = F.coalesce(*[F.when(c.contains(s), F.split(c, s, 2)) for s in ("→", "è", "-")])
    return let(F.transform(both, allowed), lambda x: F.when((F.get(x, 0) != "") & (F.get(x, 1) != ""), F.struct(F.get(x, 0).alias("source"), F.get(x, 1).alias("target"))))


def base_name(c: Column) -> Column:
    """A name without digits and dots at its end."""
    return clean(F.regexp_replace(c, "[0-9。.]*$", ""))


def related(a: Column, b: Column) -> Column:
    """Names of one base, or of which one holds the other and is at most a quarter longer."""
    x, y = base_name(a), base_name(b)
    near = F.least(F.length(x), F.length(y)) >= 0.8 * F.greatest(F.length(x), F.length(y))
    return F.coalesce((x != "") & (y != "") & ((x == y) | near & (x.contains(y) | y.contains(x))), F.lit(False))


def short_id(c: Column) -> Column:
    return F.left(c, F.lit(8))
