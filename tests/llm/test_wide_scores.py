"""op11: scores beyond 64 bits, and the query's types."""

from quillspark.llm import hard_negatives as H
from tests.llm.test_hard_negatives import brute, got


def test_negative_products_beyond_64_bits_round_as_whole_numbers(spark):
    rows = [(i, i % 2, [float((i - 4) * 2**33 + i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<double>")
    want = brute(rows, [rows[0], rows[8]], 5, 10)
    assert want and max(abs(x) for r in want for x in r[4:]) >= 2**63
    assert got(H.mine(df, df.filter("vec_id in (0, 8)").withColumnRenamed("vec_id", "anchor_id"))) == want


def test_query_returns_longs(spark):
    types = dict(H.op11_hard_negatives(spark, "/root/testdata/sf0.001").dtypes)
    assert types["positive_score"] == types["negative_score"] == "bigint"
