"""Entry B: wide extract -> conformed star schema -> verified Parquet tables.

read (column-pruned) -> recode / reshape (narrow, no shuffle) -> hash keys ->
mapping gate -> write.  Shuffles happen only for the geography dedupe (bounded
by the number of states) and the verification joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import conform as C
from ..operators.quality import orphan_checks, row_counts
from ..schemas import Star


def build_star(wide: DataFrame, who_sba: DataFrame, who_mmr: DataFrame) -> Star:
    geography = C.build_geography(wide)
    return Star(
        geography=geography,
        woman=C.build_woman(wide, geography),
        birth=C.build_birth(wide),
        anc=C.build_anc(wide),
        mortality=C.build_mortality(wide),
        who_sba=who_sba,
        who_mmr=who_mmr,
    )


def build_keyed_star(wide: DataFrame, who_sba: DataFrame, who_mmr: DataFrame, key_root: str,
                     load: int) -> Star:
    """The star of one load with keys from the persisted maps under ``key_root``: a respondent
    or state keeps its key in every later load, and no hash decides over it."""
    geography, keyed = C.key_respondents(wide, key_root, load)
    birth, anc, mortality = C.keyed_facts(keyed)
    return Star(geography=geography, woman=C.keyed_woman(keyed, geography), birth=birth, anc=anc,
                mortality=mortality, who_sba=who_sba, who_mmr=who_mmr)


def run_etl(spark: SparkSession, wide: DataFrame, who_sba: DataFrame, who_mmr: DataFrame,
            out_root: str) -> DataFrame:
    """Build, gate, write, re-read and verify; returns the row-count report."""
    from ..sources.io import read_star, write_star
    star = build_star(wide, who_sba, who_mmr)
    C.assert_unique_keys(star)
    C.assert_mapped(star)
    write_star(star, out_root)
    loaded = read_star(spark, out_root)
    failed = orphan_checks(loaded).where("status = 'FAIL'").count()
    if failed:
        raise C.MappingError(f"{failed} referential-integrity checks failed after load")
    return row_counts(loaded)
