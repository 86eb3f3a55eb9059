from pyspark.sql import functions as F

from cohortlens.llm.prefilter import may_hold


def test_no_held_key_is_dropped_and_few_others_stay(shipped):
    rows = shipped.range(200_000).withColumn("_block", F.lit("clash"))
    held = shipped.range(0, 200_000, 50).toDF("k")
    got = may_hold(rows, F.col("id"), held)
    assert got.columns == rows.columns
    ids = {r.id for r in got.collect()}
    assert set(range(0, 200_000, 50)) <= ids
    assert len(ids) < 4_000 + 0.02 * 200_000


def test_binary_null_and_no_keys(shipped):
    rows = shipped.createDataFrame([(b"a", 1), (b"b", 2), (None, 3)], "key binary, v int")
    held = shipped.createDataFrame([(b"a",), (None,)], "k binary")
    assert 1 in {r.v for r in may_hold(rows, F.col("key"), held).collect()}
    assert 3 not in {r.v for r in may_hold(rows, F.col("key"), held).collect()}
    assert may_hold(rows, F.col("key"), held.limit(0)).count() == 0
