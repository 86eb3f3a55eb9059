"""Entry D: the nine dashboard extracts, each a small aggregate written as one
CSV (the reference's published files), plus CSV backups of cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..schemas import Star
from ..sources.io import write_extract
from . import analyses as N

EXTRACTS = {
    "state_risk_scores": N.state_risk_extract,
    "zone_summary": N.zone_extract,
    "wealth_disaggregation": N.wealth_extract,
    "education_disaggregation": N.education_extract,
    "mmr_trend": lambda s: N.trend_band(s.who_mmr).drop("target"),
    "national_kpis": N.national_kpis,
    "care_pathway_funnel": N.care_funnel,
    "death_profile_zone": N.death_profile_extract,
    "delivery_attendant_zone": N.share_within_zone,
}


def extract_frames(star: Star) -> dict[str, DataFrame]:
    return {name: fn(star) for name, fn in EXTRACTS.items()}


def publish_extracts(star: Star, root: str) -> list[str]:
    """Write every extract as ``<root>/<name>/part-*.csv`` (one file each)."""
    out = []
    for name, df in extract_frames(star).items():
        path = f"{root.rstrip('/')}/{name}"
        write_extract(df, path)
        out.append(path)
    return out


def backup_tables_csv(star: Star, root: str) -> None:
    """CSV copies of the cleaned tables (written in parallel, one folder each)."""
    for name, df in star.tables().items():
        df.write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/{name}")
