"""Searched-CASE labels, tiers, verdicts and the composite risk score.

Fixed values (must equal the reference's labels and weights):

* trend directions: Baseline, Improving, Worsening, No Change
* year-on-year labels: Improving, Declining, Stable, Baseline
* care-gap tiers: Critical Care Gap (facility < 20 and zero-ANC > 30),
  Significant Care Gap (facility < 40 and zero-ANC > 20), else Moderate
* composite score weights: death rate / 30 * 100 * 0.35, zero ANC * 0.25,
  (100 - facility) * 0.25, double barrier * 0.15, rounded to 1 decimal
* benchmark verdicts: within +/- 5 of the indicator -> Consistent with WHO,
  below -> Below WHO estimate, else Above WHO estimate; mean visits >= 4;
  MMR > 70 is far above the SDG target
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trend_direction(value: Column, previous: Column) -> Column:
    """NULL previous first, then below / above / equal."""
    return (F.when(previous.isNull(), "Baseline")
            .when(value < previous, "Improving")
            .when(value > previous, "Worsening")
            .otherwise("No Change"))


def trend_label(change: Column) -> Column:
    """Positive / negative / zero change, NULL last (-> Baseline)."""
    return (F.when(change > 0, "Improving")
            .when(change < 0, "Declining")
            .when(change == 0, "Stable")
            .otherwise("Baseline"))


def care_gap_category(pct_facility: Column, pct_zero_anc: Column) -> Column:
    """Tier on the already rounded percentages."""
    return (F.when((pct_facility < 20) & (pct_zero_anc > 30), "Critical Care Gap")
            .when((pct_facility < 40) & (pct_zero_anc > 20), "Significant Care Gap")
            .otherwise("Moderate"))


def composite_score(death_rate: Column, pct_zero_anc: Column, pct_facility: Column,
                    pct_double_barrier: Column, digits: int = 1) -> Column:
    """Weighted priority score; inputs are the rounded component rates, no clamp."""
    raw = (death_rate / F.lit(30.0) * F.lit(100) * F.lit(0.35)
           + pct_zero_anc * F.lit(0.25)
           + (F.lit(100) - pct_facility) * F.lit(0.25)
           + pct_double_barrier * F.lit(0.15))
    return F.round(raw, digits)


def benchmark_verdict(value: Column, reference: Column, tolerance: float = 5.0) -> Column:
    return (F.when(value.between(reference - F.lit(tolerance), reference + F.lit(tolerance)),
                   "Consistent with WHO")
            .when(value < reference, "Below WHO estimate")
            .otherwise("Above WHO estimate"))


def min_visits_verdict(mean_visits: Column, minimum: float = 4) -> Column:
    return (F.when(mean_visits >= F.lit(minimum), "Meets WHO minimum of 4 visits")
            .otherwise("Below WHO minimum of 4 visits"))


def sdg_verdict(mmr: Column, target: float = 70) -> Column:
    return (F.when(mmr > F.lit(target), "Far above SDG target of 70")
            .otherwise("Meets SDG target"))
