"""Wide -> long reshapes, slot discovery, dedupe and indicator dummies.

Slot columns (``bord_01..20``, ``m15_1..6``, ``mm1_01..09``) are discovered from
the schema on the driver (metadata only, no job).  The reshape itself is one
narrow ``inline(array(struct(...)))`` per row — no union of per-slot frames, no
shuffle — so it scales with the row count, and every slot stays in the row's
own task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_numbers(columns: list[str], prefix: str) -> list[int]:
    """Sorted slot numbers of columns named ``{prefix}_{n}`` (e.g. ``bord_01``)."""
    pat = re.compile(rf"^{re.escape(prefix)}_(\d+)$")
    return sorted({int(m.group(1)) for c in columns if (m := pat.match(c))})


def _slot(present: set[str], name: str) -> Column:
    """Column if present else typed NULL (``df_raw.get``)."""
    return F.col(name).cast("string") if name in present else F.lit(None).cast("string")


def births_long(wide: DataFrame, id_col: str = "caseid",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Birth history wide -> long: one row per recorded birth.

    Birth slots use two-digit suffixes (``bord_01``); delivery slots use one
    digit (``m15_1``) and exist only for the most recent births — later slots
    get NULL delivery fields.  Rows without a birth order are dropped.
    """
    present = set(wide.columns)          # one schema fetch for all slot lookups
    n_births = max(slot_numbers(list(present), "bord") or [0])
    n_preg = max(slot_numbers(list(present), "m15") or [0])
    slots = []
    for i in range(1, n_births + 1):
        b, m = f"_{i:02d}", f"_{i}"
        fields = [F.lit(i).alias("birth_number"),
                  _slot(present, f"bord{b}").alias("birth_order_raw"),
                  _slot(present, f"b2{b}").alias("birth_year_raw"),
                  _slot(present, f"b5{b}").alias("child_alive_raw")]
        for src in ("m15", "m3a", "m3b", "m3c", "m3d", "m3e"):
            name = "delivery_location_raw" if src == "m15" else src
            col = _slot(present, f"{src}{m}") if i <= n_preg else F.lit(None).cast("string")
            fields.append(col.alias(name))
        slots.append(F.struct(*fields))
    out = wide.select(F.col(id_col).alias("caseid"), *carry, F.inline(F.array(*slots)))
    return out.where(F.col("birth_order_raw").isNotNull())


SISTER_FIELDS = {"mm1": "sibling_sex", "mm2": "sibling_alive", "mm4": "birth_cmc_raw",
                 "mm8": "death_cmc_raw", "mm9": "cause_raw"}


def sisters_long(wide: DataFrame, id_col: str = "caseid",
                 carry: tuple[str, ...] = ("v008",)) -> DataFrame:
    """Sibling history wide -> long (slots that have a sex column), absent
    measures NULL; ``carry`` rides along (interview CMC) so no self-join is
    needed later."""
    slots = []
    present = set(wide.columns)
    for j in slot_numbers(list(present), "mm1"):
        s = f"_{j:02d}"
        slots.append(F.struct(F.lit(j).alias("sibling_number"),
                              *[_slot(present, f"{k}{s}").alias(v)
                                for k, v in SISTER_FIELDS.items()]))
    if not slots:
        raise ValueError("no sibling slots (mm1_NN) in the extract")
    return wide.select(F.col(id_col).alias("caseid"), *carry, F.inline(F.array(*slots)))


def dedupe_keep_min(df: DataFrame, keys: list[str], order_col: str,
                    keep: list[str]) -> DataFrame:
    """One row per key: the row with the smallest ``order_col`` (deterministic
    replacement for keep-first-in-file-order)."""
    # hash-aggregate to distinct (key, kept values) first; the struct minimum
    # then runs on that small set only
    small = df.groupBy(*keys, *keep).agg(F.min(order_col).alias(order_col))
    best = F.min(F.struct(F.col(order_col), *[F.col(c) for c in keep])).alias("_best")
    return small.groupBy(*keys).agg(best).select(
        *keys, F.col(f"_best.{order_col}").alias(order_col),
        *[F.col(f"_best.{c}").alias(c) for c in keep])


def indicator_columns(df: DataFrame, col: str, values: list[str], prefix: str) -> DataFrame:
    """One 0/1 column per category value (``pd.get_dummies`` with a known
    category list, so the schema does not depend on the data)."""
    return df.select("*", *[F.when(F.col(col) == v, 1).otherwise(0).alias(f"{prefix}_{v}")
                            for v in values])
