"""Rate and ratio builders — the four denominator conventions of the analyses.

Every rate is an aggregate ``Column``; the denominator convention is an explicit
argument, never a default:

* ``distinct`` — unweighted ``100 * SUM(cond) / COUNT(DISTINCT id)``
* ``known``    — unweighted ``100 * SUM(cond) / SUM(x IS NOT NULL)``
* weighted ``all``   — ``SUM(w * cond) / SUM(w) * 100``
* weighted ``known`` — ``SUM(w * cond) / SUM(w * (x IS NOT NULL)) * 100``

The arithmetic order of each form is kept (``num * 100 / den`` for counts,
``num / den * 100`` for weights) so results match the reference bit for bit.
Division by zero yields NULL (``nullif``), as in the reference's database.
Rounding is HALF_UP (``F.round``) unless ``half_even=True`` (``F.bround``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END`` (NULL condition counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def weight_if(cond: Column, weight: Column | str) -> Column:
    """``CASE WHEN cond THEN w ELSE 0 END``."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.when(cond, w).otherwise(F.lit(0.0))


def _nz(den: Column) -> Column:
    return F.nullif(den, F.lit(0))


def _rnd(c: Column, digits: int | None, half_even: bool = False) -> Column:
    if digits is None:
        return c
    return F.bround(c, digits) if half_even else F.round(c, digits)


def count_pct(num: Column, den: Column, digits: int | None = 1, scale: float = 100.0,
              half_even: bool = False) -> Column:
    """``ROUND(num * scale / NULLIF(den, 0), digits)`` — count-based ratio."""
    return _rnd(num * F.lit(float(scale)) / _nz(den), digits, half_even)


def weight_pct(num: Column, den: Column, digits: int | None = 1, scale: float = 100.0,
               half_even: bool = False) -> Column:
    """``ROUND(num / NULLIF(den, 0) * scale, digits)`` — weight-based ratio."""
    return _rnd(num / _nz(den) * F.lit(float(scale)), digits, half_even)


def mean(total: Column, n: Column, digits: int | None = 1) -> Column:
    """Mean from a sum and a count (``AVG`` when rows were pre-aggregated)."""
    return _rnd(total / _nz(n).cast("double"), digits)


def rate(cond: Column, *, denom: str, weight: Column | str | None = None,
         known: Column | None = None, distinct: Column | str | None = None,
         within: Column | None = None, digits: int | None = 1) -> Column:
    """Aggregate rate over raw (not pre-aggregated) rows.

    ``denom``: ``'all'`` | ``'known'`` | ``'distinct'``.  ``known`` is the
    predicate that makes a row count in the denominator (``x IS NOT NULL``);
    ``within`` restricts numerator and denominator to a sub-population.
    """
    if within is not None:
        cond = cond & within
        if denom == "all":
            denom, known = "known", within
        elif denom == "known":
            known = within if known is None else (known & within)
        else:
            raise ValueError("'within' applies to denominators 'all' and 'known'")
    if weight is None:
        num = F.sum(flag(cond))
        if denom == "distinct":
            if distinct is None:
                raise ValueError("denom='distinct' needs the entity id column")
            d = F.col(distinct) if isinstance(distinct, str) else distinct
            return count_pct(num, F.count_distinct(d), digits)
        if denom == "known":
            return count_pct(num, F.sum(flag(known)), digits)
        if denom == "all":
            return count_pct(num, F.count(F.lit(1)), digits)
        raise ValueError(f"unknown denominator {denom!r}")
    w = F.col(weight) if isinstance(weight, str) else weight
    num = F.sum(weight_if(cond, w))
    if denom == "all":
        return weight_pct(num, F.sum(w), digits)
    if denom == "known":
        return weight_pct(num, F.sum(weight_if(known, w)), digits)
    raise ValueError(f"weighted rates take denom 'all' or 'known', not {denom!r}")


def per_thousand(events: Column, population: Column, digits: int | None = 2) -> Column:
    """Events per 1,000 (``ROUND(events * 1000.0 / NULLIF(pop, 0), 2)``)."""
    return count_pct(events, population, digits, scale=1000.0)
