"""Conform a raw wide extract into the star schema.

Surrogate keys are hashes of natural keys (``xxhash64``), so no global window
or sequence generator is needed and re-runs are idempotent.  Before any write the
ETL checks that every dimension key is unique, which a collision of two natural keys
or a repeated case id would break (with 64-bit keys a collision is to be expected
from some billions of respondents on; the load then stops, and ``key_respondents`` takes
keys from a persisted map instead, which cannot collide).  Foreign keys are resolved by joins on the
natural keys (state name + urban/rural, case id) and the mapping gate raises
when any fact row is left unmapped — before loading, not after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..schemas import (DIM_GEOGRAPHY, DIM_WOMAN, FACT_ANC, FACT_BIRTH, FACT_MORTALITY, Star,
                       conform)
from .keymap import extend_keys, with_key
from .reshape import births_long, dedupe_keep_min, sisters_long

WEIGHT_SCALE = 1_000_000     # survey weights are stored x 1e6

GEO_SOURCE = {"v001": "dhs_cluster_id", "sstate": "state_name", "v024": "geopolitical_zone",
              "v102": "urban_rural"}
WOMAN_SOURCE = {"caseid": "dhs_case_id", "sstate": "state_name", "v102": "urban_rural",
                "v012": "age_at_survey", "v106": "education_level", "v190": "wealth_index",
                "v481": "has_insurance", "v467d": "distance_barrier", "v005": "survey_weight"}
ANC_SOURCE = {"caseid": "dhs_case_id", "m14_1": "anc_visits",
              "m13_1": "months_pregnant_first_anc", "m15_1": "delivery_place_raw",
              "m3a_1": "m3a", "m3b_1": "m3b", "m3c_1": "m3c", "m3d_1": "m3d", "m3e_1": "m3e",
              "m70_1": "postnatal_check"}
FEMALE_CODES = ["2", "female"]
DEAD_CODES = ["0", "no", "dead"]


class MappingError(RuntimeError):
    """Raised when foreign keys cannot be resolved or surrogate keys collide."""


def hash_key(*cols: Column | str) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Column subset + rename (``select`` of the mapped columns only)."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def case_id(c: Column | str) -> Column:
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))


# ---------------------------------------------------------------------------
# dimensions
# ---------------------------------------------------------------------------

def build_geography(wide: DataFrame) -> DataFrame:
    g = rename(wide, GEO_SOURCE).select(
        F.col("dhs_cluster_id").cast("int").alias("dhs_cluster_id"),
        *[T.normalise_label(c).alias(c) for c in ("state_name", "geopolitical_zone",
                                                  "urban_rural")])
    g = dedupe_keep_min(g, ["state_name", "urban_rural"], "dhs_cluster_id", ["geopolitical_zone"])
    g = g.withColumn("state_id", hash_key("state_name", "urban_rural"))
    return conform(g, DIM_GEOGRAPHY)


def woman_attributes(wide: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Respondent columns renamed and recoded (state still as a name)."""
    w = rename(wide, WOMAN_SOURCE | {c: c for c in carry})
    return w.select(
        *carry,
        case_id("dhs_case_id").alias("dhs_case_id"),
        T.normalise_label("state_name").alias("state_name"),
        T.normalise_label("urban_rural").alias("urban_rural"),
        T.to_int("age_at_survey").alias("age_at_survey"),
        T.recode("education_level", T.EDUCATION_MAP).alias("education_level"),
        T.recode("wealth_index", T.WEALTH_MAP).alias("wealth_index"),
        T.recode("has_insurance", T.YES_NO_MAP).cast("int").alias("has_insurance"),
        T.recode("distance_barrier", T.DISTANCE_MAP).cast("int").alias("distance_barrier"),
        (T.to_double("survey_weight") / F.lit(float(WEIGHT_SCALE))).alias("survey_weight"),
    )


def map_state(women: DataFrame, geography: DataFrame) -> DataFrame:
    """Attach ``state_id`` by (state_name, urban_rural); the planner
    broadcasts the geography side when its size allows."""
    keys = geography.select("state_id", "state_name", "urban_rural")
    return women.join(keys, ["state_name", "urban_rural"], "left")


def build_woman(wide: DataFrame, geography: DataFrame) -> DataFrame:
    w = map_state(woman_attributes(wide), geography)
    w = w.withColumn("woman_id", hash_key("dhs_case_id"))
    return conform(w, DIM_WOMAN)


# ---------------------------------------------------------------------------
# facts
# ---------------------------------------------------------------------------

def birth_rows(wide: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Long births with cleaned values, keyed by case id."""
    b = births_long(wide, carry=carry)
    return b.select(
        *carry,
        case_id("caseid").alias("dhs_case_id"),
        F.col("birth_number"),
        T.to_int("birth_order_raw").alias("birth_order"),
        T.to_int("birth_year_raw").alias("birth_year"),
        T.recode("child_alive_raw", T.CHILD_ALIVE_MAP).cast("int").alias("child_alive"),
        F.col("delivery_location_raw"),
        T.delivery_location("delivery_location_raw").alias("delivery_location"),
        T.skilled_flag("m3a", "m3b", "m3c").alias("skilled_attendant"),
        T.attendant_priority().alias("delivery_assisted_by"),
    )


def anc_rows(wide: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Most recent birth's care (slot 1), only for women with a delivery place."""
    a = rename(wide, {k: v for k, v in ANC_SOURCE.items() if k in wide.columns}
               | {c: c for c in carry})
    a = a.where(F.col("delivery_place_raw").isNotNull())
    return a.select(
        *carry,
        case_id("dhs_case_id").alias("dhs_case_id"),
        T.clean_visits("anc_visits").alias("anc_visits"),
        T.months_to_trimester("months_pregnant_first_anc").alias("first_anc_trimester"),
        T.facility_flag("delivery_place_raw").alias("facility_delivery"),
        T.attendant_priority().alias("delivery_assisted_by"),
        T.recode("postnatal_check", T.YES_NO_MAP).cast("int").alias("postnatal_check"),
    )


def sister_rows(wide: DataFrame, filtered: bool = True,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Long sibling rows with CMC-derived years; ``filtered`` keeps only
    female, dead siblings who died within the recency window (in that order)."""
    s = sisters_long(wide, carry=("v008", *carry))
    s = s.select(
        *carry,
        case_id("caseid").alias("dhs_case_id"), "sibling_number",
        T.clean_key("sibling_sex").alias("sibling_sex"),
        T.clean_key("sibling_alive").alias("sibling_alive"),
        F.col("v008").cast("double").alias("interview_cmc"),
        T.to_double("death_cmc_raw").alias("death_cmc"),
        T.to_double("birth_cmc_raw").alias("birth_cmc"),
        F.col("cause_raw"))
    s = s.withColumn("years_since_death", D.years_between(F.col("interview_cmc"), F.col("death_cmc")))
    if filtered:
        s = (s.where(F.col("sibling_sex").isin(*FEMALE_CODES))
             .where(F.col("sibling_alive").isin(*DEAD_CODES))
             .where(D.within_recency(F.col("years_since_death"))))
    return s.select(
        *carry, "dhs_case_id", "sibling_number", "sibling_sex", "sibling_alive", "cause_raw",
        "years_since_death",
        D.age_at_event(F.col("interview_cmc"), F.col("years_since_death"), F.col("birth_cmc"))
        .alias("sibling_age_at_death"),
        D.cmc_year(F.col("death_cmc")).alias("death_year"),
        T.pregnancy_related("cause_raw").alias("pregnancy_related"))


def with_woman_key(facts: DataFrame) -> DataFrame:
    return facts.withColumn("woman_id", hash_key("dhs_case_id"))


def build_birth(wide: DataFrame) -> DataFrame:
    b = with_woman_key(birth_rows(wide))
    b = b.withColumn("birth_id", hash_key("dhs_case_id", "birth_number"))
    return conform(b, FACT_BIRTH)


def build_anc(wide: DataFrame) -> DataFrame:
    a = with_woman_key(anc_rows(wide))
    a = a.withColumn("anc_id", hash_key("dhs_case_id", F.lit("anc")))
    return conform(a, FACT_ANC)


def build_mortality(wide: DataFrame) -> DataFrame:
    m = with_woman_key(sister_rows(wide))
    m = _only_dead_sisters(m)
    m = m.withColumn("mortality_id", hash_key("dhs_case_id", "sibling_number"))
    return conform(m, FACT_MORTALITY)


def _only_dead_sisters(m: DataFrame) -> DataFrame:
    """The two columns that the filters leave constant, with their conformed values."""
    m = m.select("*", F.lit("Female").alias("sibling_sex_out"), F.lit(0).alias("sibling_alive_out"))
    return m.drop("sibling_sex", "sibling_alive") \
        .withColumnRenamed("sibling_sex_out", "sibling_sex") \
        .withColumnRenamed("sibling_alive_out", "sibling_alive")


# ---------------------------------------------------------------------------
# the same tables with keys from a persisted map
# ---------------------------------------------------------------------------

#: Room for the slot numbers of one respondent (two digits) in a fact's id.
SLOTS = 128


def key_respondents(wide: DataFrame, root: str, load: int) -> tuple[DataFrame, DataFrame]:
    """Extend the maps of states and respondents under ``root`` by this load.

    Returns the geography dimension with mapped ``state_id`` and the wide rows with
    ``woman_id``.  The key is joined to the wide rows once and rides along into all facts."""
    places = build_geography(wide).drop("state_id")
    natural = ["state_name", "urban_rural"]
    states = extend_keys(places, natural, f"{root}/geography", load)
    geography = conform(with_key(places, states, {c: c for c in natural}, "state_id"), DIM_GEOGRAPHY)
    cases = extend_keys(wide.select(case_id("caseid").alias("dhs_case_id")), ["dhs_case_id"],
                        f"{root}/woman", load)
    return geography, with_key(wide, cases, {"dhs_case_id": "trim(CAST(caseid AS STRING))"},
                               "woman_id")


def keyed_woman(wide: DataFrame, geography: DataFrame) -> DataFrame:
    attributes = map_state(woman_attributes(wide, carry=("woman_id",)), geography)
    return conform(attributes, DIM_WOMAN)


def keyed_facts(wide: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Births, care and deaths; an id is the woman's key and the slot, unique by construction."""
    def slot_id(number: str) -> Column:
        return F.col("woman_id") * SLOTS + F.col(number)

    births = birth_rows(wide, carry=("woman_id",)).withColumn("birth_id", slot_id("birth_number"))
    care = anc_rows(wide, carry=("woman_id",)).withColumn("anc_id", F.col("woman_id"))
    deaths = _only_dead_sisters(sister_rows(wide, carry=("woman_id",))).withColumn(
        "mortality_id", slot_id("sibling_number"))
    return conform(births, FACT_BIRTH), conform(care, FACT_ANC), conform(deaths, FACT_MORTALITY)


# ---------------------------------------------------------------------------
# mapping gate and key checks
# ---------------------------------------------------------------------------

def unmapped_counts(star: Star) -> DataFrame:
    """Rows whose foreign key does not resolve: women without a state, and
    fact rows whose woman is not in the dimension (keyed anti joins on
    per-key counts, so a hot key cannot skew them)."""
    from .quality import orphan_rows
    no_state = star.woman.where(F.col("state_id").isNull()) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    bad_state = orphan_rows(star.woman.where(F.col("state_id").isNotNull()),
                            star.geography, "state_id")
    woman_fk = no_state.crossJoin(bad_state).select(
        F.lit("dim_woman.state_id").alias("foreign_key"),
        (F.col("n") + F.col("orphan_count")).alias("unmapped_rows"))
    out = woman_fk
    for name, df in [("fact_birth.woman_id", star.birth),
                     ("fact_anc_delivery.woman_id", star.anc),
                     ("fact_maternal_mortality.woman_id", star.mortality)]:
        out = out.unionByName(orphan_rows(df, star.woman, "woman_id").select(
            F.lit(name).alias("foreign_key"), F.col("orphan_count").alias("unmapped_rows")))
    return out


def key_collisions(df: DataFrame, key: str, natural: list[str]) -> DataFrame:
    """Surrogate keys shared by more than one natural key (must be empty)."""
    return (df.groupBy(key).agg(F.count_distinct(*[F.col(c) for c in natural]).alias("n"))
            .where(F.col("n") > 1))


def repeated_keys(star: Star) -> DataFrame:
    """(table_name, rows): dimension rows whose key another row has too, by a repeated
    natural key or by two natural keys of one hash; both would join a fact twice."""
    out = None
    for name, df, key in (("dim_geography", star.geography, "state_id"),
                          ("dim_woman", star.woman, "woman_id")):
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def assert_unique_keys(star: Star) -> None:
    """Gate before loading: raise if a dimension key is not unique."""
    bad = repeated_keys(star).where("rows > 0").collect()      # two rows at most
    if bad:
        raise MappingError("repeated keys: " + ", ".join(f"{r.table_name}={r.rows}" for r in bad))


def assert_mapped(star: Star) -> None:
    """Gate before loading: raise if any foreign key is unmapped."""
    bad = unmapped_counts(star).where(F.col("unmapped_rows") > 0).collect()  # <= 4 rows
    if bad:
        raise MappingError("unmapped foreign keys: " +
                           ", ".join(f"{r.foreign_key}={r.unmapped_rows}" for r in bad))
