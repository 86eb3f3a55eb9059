"""Multi-fact joins without materialising the fan-out.

``woman LEFT JOIN anc LEFT JOIN mortality`` repeats a woman once per
(anc row x mortality row).  SUM/AVG over that product are inflated while
COUNT(DISTINCT id) is not; the reference's published figures carry this
inflation.  Instead of building the product we pre-aggregate each fact to woman
grain (partial aggregation map-side, one shuffle on ``woman_id``) and weight
each woman's contribution by her row multiplicity:

* woman attribute ``x``:  ``SUM(x) = sum_w x * A * M`` (A, M = max(1, rows))
* anc measure ``y``:      ``SUM(y) = sum_w (sum of y over her anc rows) * M``
* distinct fact ids:      ``COUNT(DISTINCT id) = sum_w rows`` (ids are keys)

``mode='as_published'`` applies the multiplicities (reproduces the reference);
``mode='per_entity'`` sets them to 1 (each woman counted once).  Both run as
one shuffle join of pre-aggregated facts on ``woman_id`` — no Expand, no
product, and a woman with a huge number of fact rows is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import flag
from ..schemas import SKILLED_ATTENDANTS, Star

MODES = ("as_published", "per_entity")


def anc_profile(anc: DataFrame) -> DataFrame:
    """ANC/delivery measures summed to woman grain."""
    fac, vis = F.col("facility_delivery"), F.col("anc_visits")
    tri, post = F.col("first_anc_trimester"), F.col("postnatal_check")
    return anc.groupBy("woman_id").agg(
        F.count(F.lit(1)).alias("anc_n"),
        F.sum(flag(fac == 1)).alias("anc_fac1"),
        F.sum(flag(fac.isNotNull())).alias("anc_fac_known"),
        F.sum(flag(vis == 0)).alias("anc_zero"),
        F.sum(flag(vis > 0)).alias("anc_any"),
        F.sum(flag(vis >= 4)).alias("anc_four"),
        F.sum(flag(vis.isNotNull())).alias("anc_visits_known"),
        F.coalesce(F.sum(vis), F.lit(0)).cast("bigint").alias("anc_visits_sum"),
        F.sum(flag(tri == 1)).alias("anc_tri1"),
        F.sum(flag(tri.isNotNull())).alias("anc_tri_known"),
        F.sum(flag(F.col("delivery_assisted_by").isin(*SKILLED_ATTENDANTS))).alias("anc_skilled"),
        F.sum(flag(post == 1)).alias("anc_post1"),
        F.sum(flag(post.isNotNull())).alias("anc_post_known"),
    )


def mortality_profile(mortality: DataFrame) -> DataFrame:
    """Sister-death measures summed to woman grain."""
    pr, age = F.col("pregnancy_related"), F.col("sibling_age_at_death")
    return mortality.groupBy("woman_id").agg(
        F.count(F.lit(1)).alias("mort_n"),
        F.sum(flag(pr == 1)).alias("mort_mat"),
        F.sum(flag(pr == 0)).alias("mort_nonmat"),
        F.sum(flag(pr.isNotNull())).alias("mort_known"),
        F.coalesce(F.sum(F.when(pr == 1, age)), F.lit(0.0)).alias("mort_mat_age_sum"),
        F.sum(flag((pr == 1) & age.isNotNull())).alias("mort_mat_age_n"),
        F.coalesce(F.sum(F.when(pr == 0, age)), F.lit(0.0)).alias("mort_nonmat_age_sum"),
        F.sum(flag((pr == 0) & age.isNotNull())).alias("mort_nonmat_age_n"),
        F.coalesce(F.sum(F.when(pr.isNull(), age)), F.lit(0.0)).alias("mort_unk_age_sum"),
        F.sum(flag(pr.isNull() & age.isNotNull())).alias("mort_unk_age_n"),
    )


def birth_profile(birth: DataFrame, where: Column | None = None) -> DataFrame:
    """Birth measures summed to woman grain (``where`` = ON-clause filters)."""
    b = birth if where is None else birth.where(where)
    return b.groupBy("woman_id").agg(
        F.count(F.lit(1)).alias("birth_n"),
        F.sum(flag(F.col("skilled_attendant") == 1)).alias("birth_skilled"),
    )


_PROFILES = {
    "anc": (anc_profile, ["anc_n", "anc_fac1", "anc_fac_known", "anc_zero", "anc_any",
                          "anc_four", "anc_visits_known", "anc_visits_sum", "anc_tri1",
                          "anc_tri_known", "anc_skilled", "anc_post1", "anc_post_known"]),
    "mort": (mortality_profile, ["mort_n", "mort_mat", "mort_nonmat", "mort_known",
                                 "mort_mat_age_sum", "mort_mat_age_n", "mort_nonmat_age_sum",
                                 "mort_nonmat_age_n", "mort_unk_age_sum", "mort_unk_age_n"]),
}


def woman_grain(star: Star, facts: tuple[str, ...] = ("anc", "mort"), *,
                with_geography: bool = False, birth_where: Column | None = None,
                mode: str = "as_published") -> DataFrame:
    """One row per woman with her fact profiles and multiplicity columns.

    Adds ``m_anc``, ``m_mort``, ``m_birth`` (max(1, rows) in ``as_published``
    mode, 1 in ``per_entity`` mode) for every fact in ``facts``.
    ``with_geography`` inner-joins the geography dimension; the planner broadcasts
    it when its size allows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w = star.woman
    filled, mults = [], []
    for fact in facts:
        if fact == "birth":
            prof, cols = birth_profile(star.birth, birth_where), ["birth_n", "birth_skilled"]
        else:
            fn, cols = _PROFILES[fact]
            prof = fn(star.anc if fact == "anc" else star.mortality)
        w = w.join(prof, "woman_id", "left")
        types = {f.name: f.dataType for f in prof.schema.fields}     # one schema fetch
        filled += [F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c) for c in cols]
        n = F.coalesce(F.col(f"{fact}_n"), F.lit(0))
        mult = F.greatest(F.lit(1), n) if mode == "as_published" else F.lit(1)
        mults.append(mult.cast("bigint").alias(f"m_{fact}"))
    profile_cols = {c for fact in facts for c in
                    (["birth_n", "birth_skilled"] if fact == "birth" else _PROFILES[fact][1])}
    base = [F.col(c) for c in w.columns if c not in profile_cols]
    out = w.select(*base, *filled, *mults)
    if with_geography:       # last, so the joins on woman_id keep a bucketed layout
        geo = star.geography.select("state_id", "state_name", "geopolitical_zone", "urban_rural")
        out = out.join(geo, "state_id")
    return out


MULT_TYPE = "decimal(38,0)"


def multiplicity(*facts: str) -> Column:
    """Row multiplicity of a woman in the joined product of ``facts``.

    Exact decimal: a woman who is hot in two facts can have a product of
    row counts far beyond ``bigint`` (a third of each fact at 100 TB), and the
    multiplicity-weighted integer sums must neither overflow nor round."""
    out = F.lit(1).cast(MULT_TYPE)
    for f_ in facts:
        out = out * F.col(f"m_{f_}").cast(MULT_TYPE)
    return out
