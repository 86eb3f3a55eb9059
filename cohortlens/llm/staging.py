"""Intermediate tables in the shared folder, and row handling shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import checkpoint_dir


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage (a lost executor re-reads the files instead of
    recomputing Python stages) and gives the planner the real size of the table,
    so a later join is broadcast only when the files are below Spark's own limit.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str,
             limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each.

    A row above the limit comes alone; no row is dropped or shortened.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False)
        begin, held = 0, 0
        for at, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += int(size)
        if begin < len(sizes):
            yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
