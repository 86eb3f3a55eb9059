"""Publish the seven tables as one unit.

A load writes its tables under a folder of its own, checks them there, and only then adds
its commit: one small Parquet file (a row a table, with the folder and the row count) that
appears by a single rename when its job commits.  Readers resolve the tables through the
newest commit, so they see all seven tables of a load or none, also while a load is running or after
one has failed.  Nothing that a commit names is ever written again; what a failed load
left behind is overwritten by the next one.

Two loads at a time: both take the next number, and the second commit fails, since its
folder exists.  Row counts and null counts are taken from the files that were written, so
they describe what readers will get, not what was sent.  (``DataFrame.observe`` would give
them in passing, but in Spark 4.1 a session that has observed once can no longer score with
a fitted MLlib classifier: the session, which the model's summary holds, is not serialisable
from then on.)
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conform import MappingError
from ..operators.quality import orphan_checks
from ..schemas import LOAD_ORDER, TABLE_SCHEMAS, Star
from .io import _FIELDS

_COMMIT = "table_name string, folder string, rows long, nulls map<string,long>, note string"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(version, table_name, folder, rows, nulls, note) of every commit; empty before the first."""
    schema = f"{_COMMIT}, version int"
    try:
        return spark.read.schema(schema).parquet(f"{root}/commits").select(
            "version", "table_name", "folder", "rows", "nulls", "note")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).select(
            "version", "table_name", "folder", "rows", "nulls", "note")


def latest_version(spark: SparkSession, root: str) -> int:
    """The newest committed version, 0 before the first."""
    return commits(spark, root).agg(F.max("version")).first()[0] or 0


def _add_commit(spark: SparkSession, root: str, version: int, entries: list[tuple]) -> None:
    """One file of seven rows; ``errorifexists`` stops a second writer of this version."""
    spark.createDataFrame(entries, _COMMIT).coalesce(1).write.mode("errorifexists").parquet(
        f"{root}/commits/version={version}")


def _written(df: DataFrame, name: str, folder: str) -> tuple[int, dict[str, int]]:
    """Write a table; the row count and null counts of its files, in one pass."""
    df.write.mode("overwrite").parquet(folder)
    schema = TABLE_SCHEMAS[name]
    got = df.sparkSession.read.schema(schema).parquet(folder).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(f.name).isNull(), 1)).alias(f"null_{f.name}")
                                           for f in schema.fields]).first()
    return got["rows"], {f.name: got[f"null_{f.name}"] for f in schema.fields}


def _star(spark: SparkSession, folders: dict[str, str]) -> Star:
    return Star(**{field: spark.read.schema(TABLE_SCHEMAS[name]).parquet(folders[name])
                   for name, field in _FIELDS.items()})


def commit_star(star: Star, root: str, note: str = "", check: bool = True) -> int:
    """Write ``star`` as the next version, check its foreign keys, commit it; returns the version.

    An error before the commit, of a write or of a check, leaves readers on the version before."""
    spark = star.woman.sparkSession
    version = latest_version(spark, root) + 1
    tables, folders, entries = star.tables(), {}, []
    for name in LOAD_ORDER:
        folders[name] = f"{root}/data/version={version}/{name}"
        rows, nulls = _written(tables[name], name, folders[name])
        entries.append((name, folders[name], rows, nulls, note))
    if check:
        failed = orphan_checks(_star(spark, folders)).where("status = 'FAIL'").collect()  # four rows
        if failed:
            raise MappingError("not committed: " + ", ".join(
                f"{r.check_name}: {r.orphan_count}" for r in failed))
    _add_commit(spark, root, version, entries)
    return version


def read_committed(spark: SparkSession, root: str, version: int | None = None) -> Star:
    """The tables of a version (the newest, where none is named)."""
    version = version or latest_version(spark, root)
    folders = {r.table_name: r.folder for r in commits(spark, root).where(
        F.col("version") == version).collect()}  # seven rows
    if set(folders) != set(LOAD_ORDER):
        raise LookupError(f"{root} holds no committed version {version or ''}".rstrip())
    return _star(spark, folders)


def roll_back(spark: SparkSession, root: str, version: int, note: str = "rollback") -> int:
    """Commit the tables of an earlier version again, as the newest; nothing is copied."""
    entries = [(r.table_name, r.folder, r.rows, r.nulls, note) for r in commits(spark, root).where(
        F.col("version") == version).collect()]  # seven rows
    if len(entries) != len(LOAD_ORDER):
        raise LookupError(f"{root} holds no committed version {version}")
    newest = latest_version(spark, root) + 1
    _add_commit(spark, root, newest, entries)
    return newest
