"""Raw wide-extract analogue: one row per respondent with numbered slot columns
and label-or-digit coded values, derived from the driver tables.

* respondent           <- customer and round (+ nation as state, region as zone)
* birth slots 1..20    <- the customer's orders, latest key first (``bord_NN``,
  ``b2_NN``, ``b5_NN``); the six most recent slots also carry delivery data
  (``m15_i``, ``m3a_i`` .. ``m3e_i``) and slot 1 the antenatal answers
  (``m14_1``, ``m13_1``, ``m70_1``)
* sister slots 1..9    <- the user's events, latest id first
  (``mm1_NN``, ``mm2_NN``, ``mm4_NN``, ``mm8_NN``, ``mm9_NN``)

Like the survey instrument, a row has a fixed number of slots.  A customer with
more orders or events than slots fills several rows (rounds 1, 2, ...), each a
respondent of its own case id, so every order is a birth and every event a
sibling; nothing is dropped.

The raw columns are SQL expressions shared with the DuckDB oracle.  The label
lists below are fixed values of this test extract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import place_within

N_BIRTH_SLOTS = 20
N_DELIVERY_SLOTS = 6
N_SISTER_SLOTS = 9


def _case(key: str, labels: list[str | None], mod: int | None = None) -> str:
    mod = mod or len(labels)
    parts = []
    for i, lab in enumerate(labels):
        val = "NULL" if lab is None else "'" + lab.replace("'", "''") + "'"
        parts.append(f"WHEN {key} % {mod} = {i} THEN {val}")
    return f"CASE WHEN {key} IS NULL THEN NULL {' '.join(parts)} END"


PLACE_LABELS = ["respondent's home", "her home", "other home", "government hospital",
                "government health centre", "government health post", "private hospital",
                "private clinic", "mission hospital", "ngo health facility", "maternity home",
                "dispensary", "on the road", "other", "none", "public health clinic"]
VISIT_LABELS = ["no antenatal visits", "0", "1", "2", "3", "4", "4.9", "5", "6", "8", "10", "12",
                "98", "don't know", "7", "99", None]
MONTH_LABELS = ["0", "3", "3.5", "6", "7", "98", "x", "2", "5", None]
YESNO_LABELS = ["yes", "no", "1", "0", "dk"]
CAUSE_LABELS = ["died while pregnant", "died during delivery", "since delivery, 6 weeks",
                "2 months after delivery", "death not related to pregnancy", "never pregnant",
                "violence", "accident", None]

RESPONDENT_COLS = {
    "caseid": "'   ' || CAST(c_custkey AS STRING) || '  ' || CAST(round AS STRING)",
    "v001": "CAST(c_nationkey * 10 + c_custkey % 3 AS INT)",
    "sstate": "CASE WHEN c_custkey % 5 = 0 THEN ' ' || lower(n_name) ELSE upper(n_name) || ' ' END",
    "v024": "CASE WHEN c_custkey % 2 = 0 THEN lower(r_name) ELSE r_name END",
    "v102": "CASE WHEN c_custkey % 3 = 0 THEN 'urban' ELSE 'Rural' END",
    "v012": "CAST(15 + c_custkey % 35 AS INT)",
    "v106": _case("c_custkey", ["no education", "primary", "secondary", "higher", "0", "1",
                                " 2", "3", "dk"]),
    "v190": _case("c_custkey", ["poorest", "poorer", "middle", "richer ", "richest", "1", "2",
                                "3", "4", "5", "Poorer"]),
    "v481": _case("c_custkey", ["yes", "no", "1", "0", "No", "dk"]),
    "v467d": _case("c_custkey", ["big problem", "not a big problem", "not a problem", "1", "2",
                                 "3", "dk"]),
    "v005": "CAST(500000 + (c_custkey % 101) * 10000 AS BIGINT)",
    "v008": "CAST(1489 - c_custkey % 12 AS INT)",
}


def birth_slot_cols(i: int) -> dict[str, str]:
    k, d, st = f"o{i}_k", f"o{i}_d", f"o{i}_st"
    cols = {
        f"bord_{i:02d}": f"CAST(1 + {k} % 9 AS STRING)",
        f"b2_{i:02d}": f"CAST(year({d}) + 26 AS STRING)",
        f"b5_{i:02d}": _case(k, ["yes", "no", "1", "dead", "unknown"]),
    }
    if i <= N_DELIVERY_SLOTS:
        cols.update({
            f"m15_{i}": f"CASE WHEN {st} = 'P' THEN NULL ELSE {_case(k, PLACE_LABELS)} END",
            f"m3a_{i}": _case(k, ["yes", "1", "no", "no", "no", None]),
            f"m3b_{i}": _case(k, ["yes", " YES ", "no", "0", None], 5),
            f"m3c_{i}": _case(k, ["yes", "no", "no", "no", "no", "no", "no"]),
            f"m3d_{i}": _case(k, ["yes", "no", None]),
            f"m3e_{i}": _case(k, ["yes", "no", "no", "no"]),
        })
    if i == 1:
        cols["m14_1"] = _case(k, VISIT_LABELS)
        cols["m13_1"] = _case(k, MONTH_LABELS)
        cols["m70_1"] = _case(k, YESNO_LABELS)
    return cols


def sister_slot_cols(j: int) -> dict[str, str]:
    e, t = f"e{j}_id", f"e{j}_type"
    return {
        f"mm1_{j:02d}": (f"CASE WHEN {e} IS NULL THEN NULL "
                         f"WHEN {t} IN ('error', 'purchase', 'view') AND {e} % 2 = 0 THEN 'female' "
                         f"WHEN {t} IN ('error', 'purchase', 'view') THEN '2' ELSE 'male' END"),
        f"mm2_{j:02d}": _case(e, ["alive", "0", "dead", "no"]),
        f"mm4_{j:02d}": f"CAST(800 + {e} % 500 AS STRING)",
        f"mm8_{j:02d}": f"CAST(1390 + {e} % 110 AS STRING)",
        f"mm9_{j:02d}": _case(e, CAUSE_LABELS),
    }


def wide_cols() -> dict[str, str]:
    cols = dict(RESPONDENT_COLS)
    for i in range(1, N_BIRTH_SLOTS + 1):
        cols.update(birth_slot_cols(i))
    for j in range(1, N_SISTER_SLOTS + 1):
        cols.update(sister_slot_cols(j))
    return cols


def wide_extract(spark: SparkSession, sf_dir: str, materialise: bool = True) -> DataFrame:
    """The raw wide extract (one row per customer).

    In the survey pipeline the extract is a file the ETL reads; here it is
    derived from the driver tables once per session and folder and written as
    Parquet into ``spark.checkpoint.dir`` — the ETL then reads the columns it
    needs from that file, and its lineage is cut."""
    from ..llm.staging import stage
    from .analogue import analogue_star
    a = analogue_star(spark, sf_dir)
    key = "wide" if materialise else "wide_lazy"
    if key not in a.extras:
        df = _build_wide(a.t)
        if materialise:
            df = stage(df, "wide")
        a.extras[key] = df
    return a.extras[key]


def _rounds(rows: DataFrame, owner: str, key: str, slots: int, fields: dict[str, str],
            prefix: str) -> DataFrame:
    """One row per (owner, round) with the ``fields`` of its ``slots`` rows side by
    side: ``<prefix><slot>_<name>``.  The place of a row is its rank by descending
    key within its owner; an owner of a great many rows is dealt out over ranges of the key
    and meets in no single task.  Rows without an owner belong to no respondent."""
    owned = rows.select(owner, *fields.values()).where(F.col(owner).isNotNull())
    placed = place_within(owned, owner, key, "_place")
    rounds = placed.groupBy(F.col(owner).alias("c_custkey"), (F.floor(
        F.col("_place") / slots) + 1).cast("int").alias("round")).agg(F.sort_array(F.collect_list(
            F.struct("_place", *[F.col(c).alias(n) for n, c in fields.items()]))).alias("_rows"))
    # places follow one another, so the i-th row of a round fills slot i
    return rounds.select("c_custkey", "round", *[
        F.get("_rows", F.lit(i - 1))[name].alias(f"{prefix}{i}_{name}")
        for i in range(1, slots + 1) for name in fields])


def _build_wide(t) -> DataFrame:
    births = _rounds(t["orders"], "o_custkey", "o_orderkey", N_BIRTH_SLOTS,
                     {"k": "o_orderkey", "d": "o_orderdate", "st": "o_orderstatus"}, "o")
    sisters = _rounds(t["events"], "user_id", "event_id", N_SISTER_SLOTS,
                      {"id": "event_id", "type": "event_type"}, "e")
    filled = births.join(sisters, ["c_custkey", "round"], "full")
    # nation (25 rows) and region (5 rows) have a fixed size at every scale factor
    geo = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    base = (t["customer"].join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(filled, "c_custkey", "left")
            .withColumn("round", F.coalesce("round", F.lit(1))))
    return base.select(*[F.expr(e).alias(k) for k, e in wide_cols().items()])


# ---------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------

def oracle_views() -> dict[str, str]:
    def placed(table: str, owner: str, key: str, slots: int) -> str:
        return (f"SELECT *, CAST((n - 1) // {slots} + 1 AS INT) AS round, (n - 1) % {slots} + 1 AS slot "
                f"FROM (SELECT *, row_number() OVER (PARTITION BY {owner} ORDER BY {key} DESC) AS n "
                f"FROM {table})")

    births = ", ".join(f"max(o_orderkey) FILTER (slot = {i}) AS o{i}_k, "
                       f"max(o_orderdate) FILTER (slot = {i}) AS o{i}_d, "
                       f"max(o_orderstatus) FILTER (slot = {i}) AS o{i}_st"
                       for i in range(1, N_BIRTH_SLOTS + 1))
    sisters = ", ".join(f"max(event_id) FILTER (slot = {j}) AS e{j}_id, "
                        f"max(event_type) FILTER (slot = {j}) AS e{j}_type"
                        for j in range(1, N_SISTER_SLOTS + 1))
    slots = ("SELECT c.*, n.*, r.*, f.* EXCLUDE (c_custkey, round), coalesce(f.round, 1) AS round "
             "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
             "JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN "
             "(SELECT * FROM birth_rounds FULL JOIN sister_rounds USING (c_custkey, round)) f "
             "ON f.c_custkey = c.c_custkey")
    wide = "SELECT " + ", ".join(f"{e} AS {k}" for k, e in wide_cols().items()) + " FROM slots"
    return {
        "order_places": placed("orders", "o_custkey", "o_orderkey", N_BIRTH_SLOTS),
        "event_places": placed("events", "user_id", "event_id", N_SISTER_SLOTS),
        "birth_rounds": f"SELECT o_custkey AS c_custkey, round, {births} FROM order_places "
                        "GROUP BY o_custkey, round",
        "sister_rounds": f"SELECT user_id AS c_custkey, round, {sisters} FROM event_places "
                         "GROUP BY user_id, round",
        "slots": slots,
        "wide": wide,
    }
