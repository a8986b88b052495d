"""Categories of very many different beginnings all have codes."""

from geoloom.operators.layers import category_codes


def test_codes_of_many_heads(spark):
    n = 72_000
    chars = [chr(c) for c in range(0x4E00, 0x4E00 + 269)]
    values = sorted({a + b for a in chars for b in chars})[:n]
    rows = spark.createDataFrame([(v,) for v in values], "c string")
    got = {r["value"]: r["code"] for r in category_codes(rows, "c", 1000).collect()}
    assert got == {v: k % 1000 for k, v in enumerate(values)}
