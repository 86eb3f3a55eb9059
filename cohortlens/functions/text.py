"""Text normalisation, dictionary recodes, numeric coercion and the ordered
substring classifiers of the survey extract — all as JVM column expressions
(no Python UDF).  Values may arrive as label strings or as digit codes; every
recode accepts both.

Fixed values (must equal the reference's code lists; order matters where the
rules are tested in sequence):

* education: 0 / no education -> None, 1 / primary -> Primary,
  2 / secondary -> Secondary, 3 / higher -> Higher
* wealth: 1 / poorest -> Poorest, 2 / poorer -> Poor, 3 / middle -> Middle,
  4 / richer -> Rich, 5 / richest -> Richest
* yes/no: 0 / no -> 0, 1 / yes -> 1;   child alive also: dead -> 0
* distance: 1 / big problem -> 1, 2 / not a big problem -> 0, 3 / not a problem -> 0
* delivery place: home words (home, respondent, her home, other home, parents)
  -> Home; then public words (government, public, health centre, health post,
  hospital, maternity, dispensary) -> Government Facility; then private words
  (private, clinic, ngo, mission) -> Private Facility; nan / none / '' -> NULL;
  anything else -> Other
* facility flag words: government, public, private, clinic, hospital,
  health centre, health post, ngo, mission -> 1; nan / none / '' -> NULL; else 0
* attendant priority: m3a Doctor, m3b Nurse or Midwife, m3c Auxiliary Midwife,
  m3d Traditional Birth Attendant, m3e Other, none -> 'None' (a category)
* skilled flag: any of m3a, m3b, m3c in (1, yes)
* visits: 'no antenatal visits' / 0 -> 0; numeric >= 98 -> NULL; else truncated
* months at first visit: >= 98 -> NULL; <= 3 -> 1; <= 6 -> 2; else 3
* cause of death: pregnant, delivery, 6 weeks, 2 months, died while,
  died during -> 1; then 'not related' -> 0; else NULL
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EDUCATION_MAP = {"0": "None", "no education": "None", "1": "Primary", "primary": "Primary",
                 "2": "Secondary", "secondary": "Secondary", "3": "Higher", "higher": "Higher"}
WEALTH_MAP = {"1": "Poorest", "poorest": "Poorest", "2": "Poor", "poorer": "Poor",
              "3": "Middle", "middle": "Middle", "4": "Rich", "richer": "Rich",
              "5": "Richest", "richest": "Richest"}
YES_NO_MAP = {"0": 0, "no": 0, "1": 1, "yes": 1}
CHILD_ALIVE_MAP = {"yes": 1, "1": 1, "no": 0, "0": 0, "dead": 0}
DISTANCE_MAP = {"1": 1, "big problem": 1, "2": 0, "not a big problem": 0,
                "3": 0, "not a problem": 0}

HOME_WORDS = ["home", "respondent", "her home", "other home", "parents"]
PUBLIC_WORDS = ["government", "public", "health centre", "health post", "hospital",
                "maternity", "dispensary"]
PRIVATE_WORDS = ["private", "clinic", "ngo", "mission"]
FACILITY_WORDS = ["government", "public", "private", "clinic", "hospital", "health centre",
                  "health post", "ngo", "mission"]
EMPTY_WORDS = ["nan", "none", ""]
YES_CODES = ["1", "yes"]
ATTENDANT_PRIORITY = [("m3a", "Doctor"), ("m3b", "Nurse or Midwife"),
                      ("m3c", "Auxiliary Midwife"), ("m3d", "Traditional Birth Attendant"),
                      ("m3e", "Other")]
SKILLED_COLUMNS = ["m3a", "m3b", "m3c"]
PREGNANCY_WORDS = ["pregnant", "delivery", "6 weeks", "2 months", "died while", "died during"]
NOT_RELATED = "not related"
NO_VISITS = ["no antenatal visits", "0"]
UNKNOWN_CODE_MIN = 98


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_key(c: Column | str) -> Column:
    """``str(x).strip().lower()`` with NULL kept as NULL."""
    return F.lower(F.trim(_c(c).cast("string")))


def as_text(c: Column | str) -> Column:
    """``str(x).strip().lower()`` where a missing value reads as ``'nan'``."""
    return F.coalesce(clean_key(c), F.lit("nan"))


def title_case(c: Column | str) -> Column:
    """Python ``str.title()``: upper-case the first letter of every letter run
    (``initcap`` only capitalises after whitespace)."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(
        runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def normalise_label(c: Column | str) -> Column:
    """trim + title case (state, zone, urban/rural labels)."""
    return title_case(F.trim(_c(c).cast("string")))


def recode(c: Column | str, mapping: dict) -> Column:
    """Dictionary recode of the cleaned key; unmapped values become NULL."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, clean_key(c))


def _raw_double(c: Column | str) -> Column:
    """``float(str(x).strip())``: junk NULL, the text 'nan' stays NaN."""
    return F.trim(_c(c).cast("string")).try_cast("double")


def to_double(c: Column | str) -> Column:
    """``pd.to_numeric(errors='coerce')``: junk and NaN become NULL (ANSI-safe;
    a missing value is never carried as NaN)."""
    d = _raw_double(c)
    return F.when(~F.isnan(d), d)


def to_int(c: Column | str) -> Column:
    """Nullable integer: integral numbers are kept, anything else is NULL."""
    d = to_double(c)
    return F.when(d.isNotNull() & ~F.isnan(d) & (d == F.floor(d)), d.cast("int"))


def _any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def delivery_location(raw: Column | str) -> Column:
    """Ordered substring rules -> Home / Government Facility / Private Facility / Other."""
    v = as_text(raw)
    return (F.when(_any_contains(v, HOME_WORDS), "Home")
            .when(_any_contains(v, PUBLIC_WORDS), "Government Facility")
            .when(_any_contains(v, PRIVATE_WORDS), "Private Facility")
            .when(v.isin(*EMPTY_WORDS), F.lit(None).cast("string"))
            .otherwise("Other"))


def facility_flag(raw: Column | str) -> Column:
    """1 for any facility word, NULL for empty, else 0 (its own word list)."""
    v = as_text(raw)
    return (F.when(_any_contains(v, FACILITY_WORDS), F.lit(1))
            .when(v.isin(*EMPTY_WORDS), F.lit(None).cast("int"))
            .otherwise(F.lit(0)))


def is_yes(c: Column | str) -> Column:
    return as_text(c).isin(*YES_CODES)


def skilled_flag(*cols: Column | str) -> Column:
    """1 when any of the (doctor, nurse/midwife, auxiliary) columns says yes."""
    cols = cols or tuple(SKILLED_COLUMNS)
    return F.when(reduce(lambda a, b: a | b, [is_yes(c) for c in cols]), 1).otherwise(0)


def attendant_priority(cols: dict[str, Column | str] | None = None) -> Column:
    """Most skilled attendant present; ``'None'`` when nobody (a category)."""
    cols = cols or {k: k for k, _ in ATTENDANT_PRIORITY}
    out = None
    for key, label in ATTENDANT_PRIORITY:
        cond = is_yes(cols[key])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("None")


def clean_visits(raw: Column | str) -> Column:
    """Visit count: label -> 0, codes >= 98 -> NULL, truncate, junk -> NULL."""
    v = as_text(raw)
    d = v.try_cast("double")
    return (F.when(v.isin(*NO_VISITS), F.lit(0))
            .when(d.isNull() | F.isnan(d), F.lit(None).cast("int"))
            .when(d >= UNKNOWN_CODE_MIN, F.lit(None).cast("int"))
            .otherwise(d.cast("int")))


def months_to_trimester(raw: Column | str) -> Column:
    """Months pregnant at first visit -> trimester 1-3 (>= 98 unknown); the
    text 'nan' compares false everywhere in the original, so it lands in 3."""
    d = _raw_double(raw)
    return (F.when(d.isNull(), F.lit(None).cast("int"))
            .when(F.isnan(d), F.lit(3))
            .when(d >= UNKNOWN_CODE_MIN, F.lit(None).cast("int"))
            .when(d <= 3, F.lit(1))
            .when(d <= 6, F.lit(2))
            .otherwise(F.lit(3)))


def pregnancy_related(raw: Column | str, negation_guard: bool = False) -> Column:
    """1 if any pregnancy word, 0 if 'not related', else NULL.

    By default a negated label ('never pregnant') still counts as 1, exactly as
    in the reference; ``negation_guard=True`` maps labels starting with
    'never'/'not' or containing 'not related' to 0 first."""
    v = as_text(raw)
    out = F.when(v.contains(NOT_RELATED) | v.startswith("never") | v.startswith("not "),
                 F.lit(0)) if negation_guard else None
    hit = _any_contains(v, PREGNANCY_WORDS)
    out = F.when(hit, F.lit(1)) if out is None else out.when(hit, F.lit(1))
    return out.when(v.contains(NOT_RELATED), F.lit(0)).otherwise(F.lit(None).cast("int"))
