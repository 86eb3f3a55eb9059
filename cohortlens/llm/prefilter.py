"""Rows that cannot meet a key set are dropped where they are read, before a shuffle.

A blocked Bloom filter as DataFrame work: a key's hash names a block of 32,768 bits (one
row, 4 KB) and three bits in it.  The filter has sixteen bits a key, up to
``MOST_BLOCKS`` blocks (64 MB), so what is broadcast has a fixed bound.  Beyond it the
filter lets more rows through; it never drops a row whose key is in the set, and the
join behind it decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32768
BITS_A_KEY = 16
MOST_BLOCKS = 1 << 14


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(blocks)).cast("int")


def _places(key: Column) -> list[Column]:
    mixed = F.xxhash64(key, F.lit(29))
    return [F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(F.lit(BITS - 1)) for i in range(3)]


def _has_bit(bits: Column, place: Column) -> Column:
    word = F.get(bits, F.shiftright(place, 6).cast("int"))
    return F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def may_hold(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` without those whose ``key`` is certainly not in the one column of ``keys``.

    ``keys`` is read twice: give a staged table.  Null keys of ``rows`` are dropped.
    """
    held = keys.toDF("_k").where(F.col("_k").isNotNull())
    need = held.count() * BITS_A_KEY / BITS
    blocks = 1
    while blocks < min(need, MOST_BLOCKS):
        blocks *= 2
    spark = rows.sparkSession
    words = BITS // 64
    empty = spark.range(blocks * words).select(
        F.floor(F.col("id") / words).cast("int").alias("_block"),
        (F.col("id") % words).cast("int").alias("_word"), F.lit(0).cast("long").alias("_set"))
    # bits of a word are joined before the shuffle, and a block is 512 words
    filled = (held.select(_block(F.col("_k"), blocks).alias("_block"),
                          F.explode(F.array(*_places(F.col("_k")))).alias("_bit"))
              .select("_block", F.shiftright("_bit", 6).cast("int").alias("_word"),
                      F.expr("shiftleft(1L, cast(_bit & 63 as int))").alias("_set"))
              .unionByName(empty).groupBy("_block", "_word").agg(F.bit_or("_set").alias("_set"))
              .groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_word", "_set"))).alias("_all"))
              .select("_block", F.col("_all._set").alias("_bits")))
    one, two, three = (_has_bit(F.col("_bits"), p) for p in _places(F.col("_key")))
    return (rows.withColumn("_key", key).where(F.col("_key").isNotNull())
            .withColumn("_block", _block(F.col("_key"), blocks))
            .join(F.broadcast(filled), "_block").where(one & two & three).select(rows.columns))
