"""Conformed star schema: two dimensions, three facts, two indicator series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

_TYPES = {"long": LongType(), "int": IntegerType(), "double": DoubleType(),
          "string": StringType()}


def _schema(spec: str) -> StructType:
    """``"name type, ..."`` -> StructType (import-time safe, no session needed)."""
    fields = []
    for part in spec.split(","):
        name, typ = part.split()
        fields.append(StructField(name, _TYPES[typ], True))
    return StructType(fields)


DIM_GEOGRAPHY = _schema(
    "state_id long, dhs_cluster_id int, state_name string, "
    "geopolitical_zone string, urban_rural string")
DIM_WOMAN = _schema(
    "woman_id long, dhs_case_id string, state_id long, age_at_survey int, "
    "education_level string, wealth_index string, has_insurance int, "
    "distance_barrier int, survey_weight double")
FACT_BIRTH = _schema(
    "birth_id long, woman_id long, birth_order int, birth_year int, child_alive int, "
    "delivery_location string, skilled_attendant int")
FACT_ANC = _schema(
    "anc_id long, woman_id long, anc_visits int, first_anc_trimester int, "
    "facility_delivery int, delivery_assisted_by string, postnatal_check int")
FACT_MORTALITY = _schema(
    "mortality_id long, woman_id long, sibling_sex string, sibling_alive int, "
    "sibling_age_at_death double, years_since_death double, pregnancy_related int, "
    "death_year int")
WHO_SBA = _schema(
    "year int, value double, value_display int, location string, indicator_code string")
WHO_MMR = _schema(
    "year int, mmr_value double, mmr_value_low double, mmr_value_high double, "
    "location string, indicator_code string")

TABLE_SCHEMAS = {
    "dim_geography": DIM_GEOGRAPHY,
    "dim_woman": DIM_WOMAN,
    "fact_birth": FACT_BIRTH,
    "fact_anc_delivery": FACT_ANC,
    "fact_maternal_mortality": FACT_MORTALITY,
    "who_nigeria_sba": WHO_SBA,
    "who_nigeria_mmr": WHO_MMR,
}

# Load order respects foreign keys: geography <- woman <- facts.
LOAD_ORDER = ["who_nigeria_sba", "who_nigeria_mmr", "dim_geography", "dim_woman",
              "fact_birth", "fact_anc_delivery", "fact_maternal_mortality"]

# Fixed category values used by the analyses (must equal the reference's labels).
SKILLED_ATTENDANTS = ["Doctor", "Nurse or Midwife", "Auxiliary Midwife"]
POOR_QUINTILES = ["Poorest", "Poor"]


@dataclass(frozen=True)
class Star:
    """The seven conformed tables as DataFrames."""

    geography: DataFrame
    woman: DataFrame
    birth: DataFrame
    anc: DataFrame
    mortality: DataFrame
    who_sba: DataFrame
    who_mmr: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "who_nigeria_sba": self.who_sba,
            "who_nigeria_mmr": self.who_mmr,
            "dim_geography": self.geography,
            "dim_woman": self.woman,
            "fact_birth": self.birth,
            "fact_anc_delivery": self.anc,
            "fact_maternal_mortality": self.mortality,
        }


def with_tables(star: Star, **changes: DataFrame) -> Star:
    """The star with some of its tables replaced."""
    names = ("geography", "woman", "birth", "anc", "mortality", "who_sba", "who_mmr")
    return Star(**{n: changes[n] if n in changes else getattr(star, n) for n in names})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select and cast to a target schema (column order and types)."""
    from pyspark.sql import functions as F
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns for schema: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
