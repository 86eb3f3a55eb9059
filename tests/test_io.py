"""Readers and sinks."""

import glob
import os

import pytest

from cohortlens.sources.io import apply_labels, read_indicator, read_sql, read_wide, write_extract

from .fixtures import fanout_star, wide_frame

MMR_CSV = """IndicatorCode,Indicator,Location,Period,IsLatestYear,FactValueNumeric,FactValueNumericLow,FactValueNumericHigh,DateModified
MDG_0000000026,ratio,Nigeria,2023,TRUE,992.8,718.3,1540,2025-04-09T23:00:00.000Z
MDG_0000000026,ratio,Nigeria,2022,FALSE,1001.5,760,1500,2025-04-09T23:00:00.000Z
MORT_MATERNALNUM,deaths,Nigeria,2023,TRUE,75000,54000,117000,2025-04-09T23:00:00.000Z
"""
SBA_CSV = """IndicatorCode,Indicator,Location,Period,IsLatestYear,FactValueNumeric,Value,DateModified
MDG_0000000025,births,Nigeria,2024,TRUE,45.7,46,2026-04-20T23:00:00.000Z
MDG_0000000025,births,Nigeria,2022,FALSE,50.7,51,2026-04-20T23:00:00.000Z
"""


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_indicator_both_layouts(spark, tmp_out):
    from cohortlens.plans.analyses import trend_change
    mmr = read_indicator(spark, _write(tmp_out, "mmr.csv", MMR_CSV), "mmr")
    assert mmr.columns == ["year", "mmr_value", "mmr_value_low", "mmr_value_high", "location",
                           "indicator_code"]
    rows = trend_change(mmr).collect()        # the indicator filter halves the file
    assert [(r.year, r.trend_direction) for r in rows] == [(2022, "Baseline"), (2023, "Improving")]
    assert rows[1].absolute_change == -9.0 and rows[1].pct_change == -0.9
    sba = read_indicator(spark, _write(tmp_out, "sba.csv", SBA_CSV), "sba")
    assert {(r.year, r.value, r.value_display) for r in sba.collect()} == \
        {(2024, 45.7, 46), (2022, 50.7, 51)}


def test_read_wide_prunes_and_labels(spark, tmp_out):
    wide_frame(spark).write.parquet(os.path.join(tmp_out, "wide"))
    w = read_wide(spark, os.path.join(tmp_out, "wide"), ["caseid", "v106", "nope"])
    assert w.columns == ["caseid", "v106"]
    labels = spark.createDataFrame([("v106", "2", "secondary"), ("v106", "1", "primary")],
                                   "variable string, code string, label string")
    got = sorted(r.v106 or "" for r in apply_labels(w, labels, ["v106"]).collect())
    assert "secondary" in got and "2" not in got


def test_read_sql_and_extract(spark, tmp_out):
    star = fanout_star(spark)
    df = read_sql(spark, star, "SELECT COUNT(*) AS n FROM dim_woman")
    assert df.first().n == 2
    out = os.path.join(tmp_out, "extract")
    write_extract(df, out)
    files = glob.glob(os.path.join(out, "*.csv"))
    assert len(files) == 1 and open(files[0]).read().splitlines() == ["n", "2"]


def test_publish_extracts(spark, tmp_out):
    from cohortlens.plans.extracts import EXTRACTS, publish_extracts
    from cohortlens.sources.analogue import analogue_star
    paths = publish_extracts(analogue_star(spark, "/root/testdata/sf0.001").star, tmp_out)
    assert len(paths) == len(EXTRACTS) == 9
    for p in paths:
        assert len(glob.glob(os.path.join(p, "*.csv"))) == 1


def test_backup_tables_csv(spark, tmp_out):
    from cohortlens.plans.extracts import backup_tables_csv
    star = fanout_star(spark)
    backup_tables_csv(star, tmp_out)
    back = spark.read.option("header", True).csv(os.path.join(tmp_out, "fact_anc_delivery"))
    assert back.count() == 2
    # 'None' is a category, not a null, and survives the CSV round trip
    assert {r.delivery_assisted_by for r in back.collect()} == {"Doctor", "None"}


def test_apply_labels_join_path_equals_map_path(spark):
    w = wide_frame(spark).select("caseid", "v106", "v190")
    labels = spark.createDataFrame(
        [("v106", "2", "secondary"), ("v106", "1", "primary"), ("v190", "5", "richest")],
        "variable string, code string, label string")
    out = apply_labels(w, labels, ["v106", "v190"])
    assert {r.v190 for r in out.collect()} >= {"richest"}
    # one schema whatever the codebook holds
    none = apply_labels(w, labels.where("variable = 'other'"), ["v106", "v190"])
    assert none.schema == out.schema and none.columns == w.columns
    assert none.orderBy("caseid").select("v106").collect() == w.orderBy("caseid").select("v106").collect()


def test_apply_labels_tolerates_duplicate_codes(spark):
    w = wide_frame(spark).select("caseid", "v106")
    labels = spark.createDataFrame(
        [("v106", "2", "secondary"), ("v106", "2", "Secondary"), ("v106", "1", "primary")],
        "variable string, code string, label string")
    got = {r.v106 for r in apply_labels(w, labels, ["v106"]).collect()}
    assert "Secondary" in got and "2" not in got      # min label, deterministically


def test_write_extract_takes_any_size(spark, tmp_out):
    path = os.path.join(tmp_out, "big")
    write_extract(spark.range(0, 200_000, 1, 4), path)
    assert spark.read.option("header", True).csv(path).count() == 200_000


def test_read_indicator_coerces_junk_to_null(spark, tmp_out):
    bad = MMR_CSV.replace("992.8", "n/a")
    mmr = read_indicator(spark, _write(tmp_out, "bad.csv", bad), "mmr")
    vals = {r.year: r.mmr_value for r in mmr.where("indicator_code = 'MDG_0000000026'").collect()}
    assert vals == {2023: None, 2022: 1001.5}


def test_checkpoint_dir_comes_from_the_session(spark):
    from cohortlens.session import checkpoint_dir
    got = checkpoint_dir(spark)
    assert got and spark.conf.get("spark.checkpoint.dir").rstrip("/").split("/")[-1] in got


def test_bad_lines_become_rejects(spark, tmp_out):
    from cohortlens.sources.io import read_indicator
    from cohortlens.sources.rejects import RejectError, read_indicator_checked
    good = ['IndicatorCode,Location,Period,FactValueNumeric,FactValueNumericLow,FactValueNumericHigh',
            'MDG_1,Nigeria,2001,10.5,9,12', 'MDG_1,"Congo, the",2002,,8,', '']
    bad = {'MDG_1,Nigeria,20x1,10.5,9,12': "Period: no int", 'MDG_1,Nigeria,2003,n/a,9,12':
           "FactValueNumeric: no double", 'MDG_1,Nigeria,2004': "number of cells",
           'MDG_1,Nigeria,2005,1,2,3,4': "number of cells"}
    import os
    os.makedirs(f"{tmp_out}/in")
    with open(f"{tmp_out}/in/a.csv", "w") as f:
        f.write("\n".join(good + list(bad)))
    with open(f"{tmp_out}/in/b.csv", "w") as f:
        f.write("\n".join([good[0], 'MDG_1,Chad,2009,1,2,3']))
    with open(f"{tmp_out}/good.csv", "w") as f:
        f.write("\n".join([*good[:3], 'MDG_1,Chad,2009,1,2,3']))
    checked = read_indicator_checked(spark, f"{tmp_out}/in", "mmr", most=0.6)
    assert {r.line: r.reason for r in checked.rejects.collect()} == bad
    assert {r.file for r in checked.rejects.collect()} == {"a.csv"}
    same = read_indicator(spark, f"{tmp_out}/good.csv", "mmr")
    assert checked.rows.schema == same.schema
    assert sorted(map(str, checked.rows.collect())) == sorted(map(str, same.collect()))
    with pytest.raises(RejectError, match="4 of 7 lines"):
        read_indicator_checked(spark, f"{tmp_out}/in", "mmr")
    with pytest.raises(ValueError):
        read_indicator_checked(spark, f"{tmp_out}/in", "x")
