"""Century Month Code (CMC) arithmetic: months since December 1899
(January 1900 = 1).

Rounding follows the reference's pandas code: half-to-even (``bround``).
Fixed values: 12 months per year; the recency window is 7 years (on the value
rounded to one decimal, so 84 months is kept and 85 is not); plausible ages
at death are 10 to 80.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = 12
RECENT_YEARS_MAX = 7.0
AGE_MIN, AGE_MAX = 10, 80


def years_between(interview_cmc: Column, event_cmc: Column) -> Column:
    """``round((interview - event) / 12, 1)`` half-even; negatives -> NULL."""
    y = F.bround((interview_cmc - event_cmc) / F.lit(float(MONTHS)), 1)
    return F.when(y >= 0, y)


def cmc_year(cmc: Column) -> Column:
    """Calendar year ``1900 + int((cmc - 1) / 12)``; ``cmc <= 0`` -> NULL."""
    return F.when(cmc > 0, (F.lit(1900) + ((cmc - 1) / F.lit(float(MONTHS))).cast("int")))


def age_at_event(interview_cmc: Column, years_since: Column, birth_cmc: Column) -> Column:
    """Age in whole years from the *rounded* years-since value, half-even,
    outside [10, 80] -> NULL."""
    event_cmc = interview_cmc - years_since * F.lit(float(MONTHS))
    age = F.bround((event_cmc - birth_cmc) / F.lit(float(MONTHS)), 0)
    return F.when((age >= AGE_MIN) & (age <= AGE_MAX), age)


def within_recency(years_since: Column, max_years: float = RECENT_YEARS_MAX) -> Column:
    return years_since.isNotNull() & (years_since <= F.lit(max_years))
