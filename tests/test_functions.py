from pyspark.sql import functions as F

from protolith.functions import ranges, text, types


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_canonical_types(spark):
    found = values(spark, types.canonical, ["UINT32", "uinteger-32（4字节）", "字节", "4字节", "24bit", "X7", "见表", "", None, "Weird（4字节）"])
    assert [tuple(r) for r in found] == [("UINT32", 32, "normal"), ("UINT32", 32, "normal"), ("UINT8", 8, "inferred"), ("UINT32", 32, "inferred"), ("24bit", 24, "normal"), ("X7", 7, "warning"), ("", 0, "warning"), ("", 0, "warning"), ("", 0, "warning"), ("UINT32", 32, "inferred")]


def test_bit_width(spark):
    assert values(spark, types.bit_width, ["D7", "D6~D3", "D6-D5", "D0:D7", "x"]) == [1, 4, 2, 8, 1]


def test_ranges_keep_their_radix(spark):
    given = {"0-400": "[0-400]", "0x00~0xFF": "[0x00,0xFF]", "[0, 255]": "[0,255]", "0x00-0xFF": "{0x00, 0xFF}", "-40-125": "[-40-125]", "-40~125": "[-40,125]", "{1，2}": "{1, 2}", "—": "—", "0x1701:供电 0x1702:断电": "{0x1701, 0x1702}"}
    assert values(spark, ranges.formatted, list(given)) == list(given.values())


def test_enumerations(spark):
    assert values(spark, ranges.enumerated, ["0x1701:供电 0x1702:断电", "0:关；1:开；2:自动", "0:x", "", None]) == ["{0x1701, 0x1702}", "{0, 1, 2}", None, None, None]


def test_text(spark):
    assert values(spark, text.clean, ["　a ", None]) == ["a", None]
    assert values(spark, text.fields, ["a, b；；c|d\n"]) == [["a", "b", "c", "d"]]
    assert values(spark, text.family, ["总线协议", "串行", "网络", "x"]) == [0, 1, 2, -1]
