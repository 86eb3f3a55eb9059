"""Persisted key maps, numbering without a global window, and the load as one unit."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohortlens.operators import conform as C
from cohortlens.operators.keymap import extend_keys, read_keys, with_key
from cohortlens.operators.numbering import numbered, write_ordered
from cohortlens.operators.quality import null_report, row_counts
from cohortlens.plans.etl import build_keyed_star, build_star
from cohortlens.schemas import with_tables
from cohortlens.sources import rawviews
from cohortlens.sources.analogue import analogue_star
from cohortlens.sources.versions import (commit_star, commits, latest_version, read_committed,
                                         roll_back)

from .conftest import SF_SMALL


def keys_of(df):
    return {r.name: (r.key, r.load) for r in df.collect()}


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string").repartition(3)


# -- numbering --------------------------------------------------------------

def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"))
    got = numbered(df, ["v"], start=10).collect()
    assert sorted((r.position, r.v) for r in got) == [(10 + i, i) for i in range(5000)]
    down = numbered(df, [F.desc("v")]).where("position < 3").orderBy("position").collect()
    assert [r.v for r in down] == [4999, 4998, 4997]


def test_numbering_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(x,) for x in [2, 1, None, 2, 1, None, 2]], "v int").repartition(4)
    got = sorted((r.position, r.v) for r in numbered(df, [F.asc_nulls_first("v")]).collect())
    assert [v for _, v in got] == [None, None, 1, 1, 2, 2, 2]
    assert numbered(df.where("false"), ["v"]).collect() == []


def test_ordered_files_follow_one_another(spark, tmp_out):
    df = spark.range(0, 3000, numPartitions=5).select((F.col("id") * 911 % 3000).alias("v"))
    write_ordered(df, [F.desc("v")], f"{tmp_out}/o", fmt="parquet")
    files = spark.read.parquet(f"{tmp_out}/o").select("v", F.input_file_name().alias("f")).groupBy("f") \
        .agg(F.max("v").alias("hi"), F.min("v").alias("lo")).orderBy("f").collect()
    assert all(a.lo > b.hi for a, b in zip(files, files[1:], strict=False)) and files[0].hi == 2999


# -- key maps ---------------------------------------------------------------

def test_keys_stay_and_grow(spark, tmp_out):
    root = f"{tmp_out}/keys"
    assert read_keys(spark, root) is None
    one = keys_of(extend_keys(names(spark, "b", "a", "c", "a"), ["name"], root, 1))
    assert one == {"a": (1, 1), "b": (2, 1), "c": (3, 1)}
    two = keys_of(extend_keys(names(spark, "0", "b", "z", None), ["name"], root, 2))
    assert two == {**one, "0": (4, 2), "z": (5, 2)}
    assert keys_of(extend_keys(names(spark, "z"), ["name"], root, 3)) == two


def test_a_load_that_runs_again_finds_its_keys(spark, tmp_out):
    root = f"{tmp_out}/keys"
    extend_keys(names(spark, "a"), ["name"], root, 1)
    first = keys_of(extend_keys(names(spark, "c", "b"), ["name"], root, 2))
    assert keys_of(extend_keys(names(spark, "b", "c"), ["name"], root, 2)) == first
    with pytest.raises(ValueError, match="holds already"):
        extend_keys(names(spark, "d"), ["name"], root, 1)


def test_keys_of_several_columns_with_nulls(spark, tmp_out):
    rows = spark.createDataFrame([("x", None), ("x", "u"), (None, "u"), (None, None), ("x", None)],
                                 "a string, b string")
    root = f"{tmp_out}/keys"
    extend_keys(rows, ["a", "b"], root, 1)
    keys = extend_keys(rows, ["a", "b"], root, 2)
    assert keys.count() == 3 and keys.select("key").distinct().count() == 3
    got = with_key(rows, keys, {"a": "a", "b": "b"}, "id").collect()
    assert len(got) == 5 and [r.id for r in got if r.a is None and r.b is None] == [None]
    assert len({r.id for r in got if r.a == "x" and r.b is None}) == 1


@pytest.fixture(scope="module")
def wide(spark):
    return rawviews.wide_extract(spark, SF_SMALL)


def test_colliding_hashes_stop_the_hashed_load_but_not_the_mapped_one(spark, wide, tmp_out, monkeypatch):
    """Two respondents whose hashes are one: the hash route raises, the map keeps them apart."""
    real = C.hash_key

    def planted(*cols):
        first = cols[0]
        name = F.col(first) if isinstance(first, str) else first
        return F.when(name.isin("1  1", "2  1"), F.lit(77)).otherwise(real(*cols))

    monkeypatch.setattr(C, "hash_key", planted)
    a = analogue_star(spark, SF_SMALL)
    with pytest.raises(C.MappingError, match="repeated keys: dim_woman=2"):
        C.assert_unique_keys(build_star(wide, a.who_sba, a.who_mmr))
    star = build_keyed_star(wide, a.who_sba, a.who_mmr, f"{tmp_out}/keys", 1)
    C.assert_unique_keys(star)
    C.assert_mapped(star)
    ids = {r.dhs_case_id: r.woman_id for r in star.woman.collect()}
    assert ids["1  1"] != ids["2  1"] and len(set(ids.values())) == len(ids)


def test_mapped_and_hashed_stars_hold_the_same_facts(spark, wide, tmp_out):
    a = analogue_star(spark, SF_SMALL)
    hashed = build_star(wide, a.who_sba, a.who_mmr)
    first = wide.where(F.col("caseid").rlike(" 1$"))
    build_keyed_star(first, a.who_sba, a.who_mmr, f"{tmp_out}/keys", 1)
    mapped = build_keyed_star(wide, a.who_sba, a.who_mmr, f"{tmp_out}/keys", 2)
    C.assert_mapped(mapped)

    def told(star, fact, id_col):
        cases = star.woman.select("woman_id", "dhs_case_id")
        return sorted(map(str, getattr(star, fact).join(cases, "woman_id").drop("woman_id", id_col)
                          .collect()))

    for fact, id_col in (("birth", "birth_id"), ("anc", "anc_id"), ("mortality", "mortality_id")):
        assert told(hashed, fact, id_col) == told(mapped, fact, id_col)
        ids = getattr(mapped, fact).select(id_col)
        assert ids.distinct().count() == ids.count() > 0


# -- one owner with a third of all rows --------------------------------------

def test_a_hot_owner_meets_in_no_single_task(spark):
    """Every window partitioned by the owner alone stands above an aggregate of its ranges."""
    rows = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("o_custkey"),
        F.col("id").alias("o_orderkey"))
    out = rawviews._rounds(rows, "o_custkey", "o_orderkey", 20, {"k": "o_orderkey"}, "o")
    got = {}
    for r in out.collect():
        for slot in range(1, 21):
            if r[f"o{slot}_k"] is not None:
                got[r[f"o{slot}_k"]] = (r.c_custkey, r.round, slot)
    want, owners = {}, {}
    for r in rows.collect():
        owners.setdefault(r.o_custkey, []).append(r.o_orderkey)
    for owner, held in owners.items():
        for place, key in enumerate(sorted(held, reverse=True)):
            want[key] = (owner, place // 20 + 1, place % 20 + 1)
    assert got == want and len(owners[5]) > 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for i, line in enumerate(plan):
        spec = line.split("], [")
        if "Window [" in line and len(spec) > 1 and spec[1].startswith("o_custkey") \
                and "," not in spec[1].split("]")[0]:
            assert any("Aggregate" in below for below in plan[i + 1:i + 4]), line


def test_a_query_of_the_wide_extract_reads_its_own_columns_only(spark):
    import __spark_entry__ as E
    plan = E.queries()["bin_months"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<caseid:string,m13_1:string>" in plan


def test_rows_without_an_owner_or_of_one_key_twice_fill_rounds(spark):
    rows = spark.createDataFrame([(None, 1, "x"), (3, 5, "a"), (3, 5, "b"), (3, None, "c"), (4, 9, "d")],
                                 "o_custkey long, o_orderkey long, st string")
    out = rawviews._rounds(rows, "o_custkey", "o_orderkey", 2, {"k": "o_orderkey", "st": "st"}, "o")
    got = {(r.c_custkey, r["round"]): (r.o1_k, r.o2_k, {r.o1_st, r.o2_st}) for r in out.collect()}
    assert got == {(3, 1): (5, 5, {"a", "b"}), (3, 2): (None, None, {"c", None}),
                   (4, 1): (9, None, {"d", None})}


# -- seven tables, one commit ------------------------------------------------

def failing(star, table):
    """The star with a table that cannot be written."""
    df = getattr(star, table)
    return with_tables(star, **{table: df.withColumn(
        df.columns[0], F.expr("CAST(raise_error('disk full') AS BIGINT)"))})


def test_a_failed_load_leaves_readers_on_the_version_before(spark, tmp_out):
    star = analogue_star(spark, SF_SMALL).star
    with pytest.raises(LookupError):
        read_committed(spark, tmp_out)
    assert commit_star(star, tmp_out) == 1
    before = {r.table_name: r.row_count for r in row_counts(read_committed(spark, tmp_out)).collect()}
    fewer = with_tables(star, birth=star.birth.where("birth_id % 2 = 0"))
    for table in ("geography", "birth", "mortality"):  # the third, fifth and seventh to be written
        with pytest.raises(PySparkException):
            commit_star(failing(fewer, table), tmp_out)
        assert latest_version(spark, tmp_out) == 1
        now = row_counts(read_committed(spark, tmp_out)).collect()
        assert {r.table_name: r.row_count for r in now} == before
    assert commit_star(fewer, tmp_out) == 2  # what the failed loads left is overwritten
    assert read_committed(spark, tmp_out).birth.count() == fewer.birth.count() < before["fact_birth"]
    assert read_committed(spark, tmp_out, 1).birth.count() == before["fact_birth"]


def test_orphans_are_not_committed(spark, tmp_out):
    star = analogue_star(spark, SF_SMALL).star
    lost = with_tables(star, woman=star.woman.where("woman_id % 7 <> 0"))
    with pytest.raises(C.MappingError, match="not committed: fact_birth"):
        commit_star(lost, tmp_out)
    assert latest_version(spark, tmp_out) == 0
    assert commit_star(lost, tmp_out, check=False) == 1


def test_rollback_and_second_writer(spark, tmp_out):
    star = analogue_star(spark, SF_SMALL).star
    commit_star(star, tmp_out)
    commit_star(with_tables(star, mortality=star.mortality.limit(0)), tmp_out)
    assert roll_back(spark, tmp_out, 1) == 3
    assert read_committed(spark, tmp_out).mortality.count() == star.mortality.count()
    from cohortlens.sources import versions
    with pytest.raises(PySparkException):  # a writer that took the same number
        versions._add_commit(spark, tmp_out, 3, [("dim_woman", "x", 1, {}, "")])
    assert commits(spark, tmp_out).where("version = 3").count() == 7
    with pytest.raises(LookupError):
        roll_back(spark, tmp_out, 9)


def test_counts_in_the_commit(spark, tmp_out):
    star = analogue_star(spark, SF_SMALL).star
    commit_star(star, tmp_out)
    told = {r.table_name: r for r in commits(spark, tmp_out).collect()}
    assert {n: r.rows for n, r in told.items()} == {
        r.table_name: r.row_count for r in row_counts(star).collect()}
    for r in null_report(star).collect():
        assert told[r.table_name].nulls[r.column_name] == r.null_count


def test_registered():
    assert {"key_map", "keyed_star", "star_commits", "committed_nulls"} <= set(E.queries())
