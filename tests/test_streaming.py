"""Incremental load: two deliveries, then a replay of the same files."""

import os

from cohortlens.streaming.incremental import read_loaded, start

from .fixtures import wide_frame


def test_incremental_load_is_exactly_once(spark, tmp_out):
    src, root, ck = (os.path.join(tmp_out, d) for d in ("in", "tables", "ck"))
    wide = wide_frame(spark)
    wide.where("caseid IN ('  1 1', '  2 1')").write.mode("append").parquet(src)
    q = start(spark, src, wide.schema, root, ck)
    q.awaitTermination(120)
    wide.where("caseid NOT IN ('  1 1', '  2 1')").write.mode("append").parquet(src)
    q = start(spark, src, wide.schema, root, ck)
    q.awaitTermination(120)
    q = start(spark, src, wide.schema, root, ck)        # nothing new: no duplicates
    q.awaitTermination(120)
    counts = {n: read_loaded(spark, root, n).count()
              for n in ("dim_geography", "dim_woman", "fact_birth", "fact_anc_delivery",
                        "fact_maternal_mortality")}
    assert counts == {"dim_geography": 3, "dim_woman": 5, "fact_birth": 7,
                      "fact_anc_delivery": 4, "fact_maternal_mortality": 2}
    women = read_loaded(spark, root, "dim_woman")
    assert women.where("state_id IS NULL").count() == 0
