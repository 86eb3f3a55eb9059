"""Reports kept up to date load by load equal the full recount."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohortlens.plans import analyses as N
from cohortlens.plans import maintained as M
from cohortlens.schemas import with_tables
from cohortlens.sources.analogue import analogue_star

from .conftest import SF_SMALL


def upto(star, number):
    """All rows of the loads 1 to ``number``."""
    loads = [E._third(star, k) for k in range(1, number + 1)]
    out = loads[0]
    for more in loads[1:]:
        out = with_tables(out, **{t: getattr(out, t).unionByName(getattr(more, t))
                                  for t in ("woman", "anc", "mortality")})
    return out


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


def same(spark, root, star):
    sums = M.current_sums(spark, root).cache()
    assert rows(M.zone_summary(sums)) == rows(N.zone_summary(star))
    assert rows(M.state_burden_rank(sums)) == rows(N.state_burden_rank(star))


def test_three_loads_and_one_again(spark, tmp_out):
    star = analogue_star(spark, SF_SMALL).star
    with pytest.raises(LookupError):
        M.current_sums(spark, tmp_out)
    for number in (1, 2, 3):
        M.add_load(E._third(star, number), tmp_out, number)
        same(spark, tmp_out, upto(star, number))
    M.add_load(E._third(star, 3), tmp_out, 3)  # runs again after a failure
    same(spark, tmp_out, star)


def test_a_small_load_touches_its_own_respondents(spark, tmp_out):
    """One death of one respondent: one profile is written, her traits changed or not."""
    star = analogue_star(spark, SF_SMALL).star
    M.add_load(star, tmp_out, 1)
    one = star.mortality.orderBy("mortality_id").limit(1).withColumn("mortality_id", F.lit(-1).cast("long")) \
        .withColumn("pregnancy_related", F.lit(1))
    none = with_tables(star, woman=star.woman.limit(0), anc=star.anc.limit(0), mortality=one)
    M.add_load(none, tmp_out, 2)
    assert spark.read.parquet(f"{tmp_out}/profiles/load=2").count() == 1
    same(spark, tmp_out, with_tables(star, mortality=star.mortality.unionByName(one)))
    moved = star.woman.join(one.select("woman_id"), "woman_id", "left_semi").withColumn(
        "survey_weight", F.lit(7.0)).withColumn("has_insurance", F.lit(1)).select(star.woman.columns)
    M.add_load(with_tables(none, woman=moved, mortality=one.limit(0)), tmp_out, 3)
    others = star.woman.join(moved.select("woman_id"), "woman_id", "left_anti").select(star.woman.columns)
    same(spark, tmp_out, with_tables(star, woman=others.unionByName(moved),
                                     mortality=star.mortality.unionByName(one)))


def test_facts_of_unknown_respondents_and_an_empty_load(spark, tmp_out):
    star = analogue_star(spark, SF_SMALL).star
    known = star.woman.where("woman_id % 5 <> 0")
    M.add_load(with_tables(star, woman=known), tmp_out, 1)
    same(spark, tmp_out, with_tables(star, woman=known))
    M.add_load(with_tables(star, woman=known.limit(0), anc=star.anc.limit(0),
                           mortality=star.mortality.limit(0)), tmp_out, 2)
    same(spark, tmp_out, with_tables(star, woman=known))
