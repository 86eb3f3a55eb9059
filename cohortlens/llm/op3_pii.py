r"""Personal data: pattern spans, and terms that disclose the protected entities.

Everything is DataFrame work.  The base finds e-mail addresses, IPv4 addresses, card
numbers and phone numbers in whole texts.  Their patterns are written with possessive
quantifiers and a look-behind: they match what the plain patterns match, leftmost and
without overlap, in time linear in the text.

The method protects each found value as an entity ``e``.  Corpus counts over all
documents estimate how strongly a term ``t`` near a mention reveals it:

    IC(e)     = -log2(n_e / N)
    PMI(t, e) = log2(n_te * N / (n_t * n_e))
    disclosure = PMI / IC      (1: whoever reads t knows e)

with n_e and n_t the documents that hold e and t, n_te those that hold t within
``CONTEXT`` characters of a mention of e.  A term of disclosure ``GENERALISE`` or more
that ``SUPPORT`` documents attest is generalised to its kind of word; from ``REMOVE``
on it is removed.  Base spans always stay.

With ``bounded`` no pair is left out for being rare.  PMI / IC is log2(p(e|t) N / n_e) / IC
with p(e|t) = n_te / n_t; instead of the ratio itself its lower confidence bound
(Wilson, one-sided at ``CONFIDENCE_Z``) is taken, so entities of one or two documents are
scored as well, by as much as their few counts allow.

``certain`` = (generalise, remove) asks besides for that much of the bound on p(e|t) itself.
PMI / IC tends to 1 for any share as N grows; with ``certain`` the same counts
are judged alike in every large corpus (``CERTAIN``: one sole document is enough to
generalise, three to remove).

With ``everywhere`` a disclosing term is marked at each of its places in all documents,
not near the mentions alone (the window is for the estimate); a term that is removed
for one entity is removed.  ``FULL`` has all three.

Pairs are counted after a map-side sum, term frequencies are one word count over the
corpus, and a document's spans are gathered per document only.  Whole texts are shuffled by
``sanitise`` alone: the places of all words are cut down where they are read, by a table of
the disclosing terms' hash slots (at most ``SLOTS`` numbers, whatever the corpus), and only
what is left meets the terms.  All other joins are merge joins at every size.  Places and
merged spans come from running sums in blocks, linear in a text's matches.

Defined cases: null text counts as empty and has no span; rows that repeat an id are
told apart by their text, and rows alike in both are one document in the counts and
are each returned; a null id is a document like any other; an entity in every document
carries no information, so nothing discloses it; other columns are kept by
``sanitise`` and ignored by ``find_spans``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{3,}+"
CONTEXT = 64
SUPPORT = 3
GENERALISE, REMOVE = 0.7, 0.9
CONFIDENCE_Z = 1.645  # 95 in 100
#: Least bound on p(e|t) to generalise and to remove.
CERTAIN = (0.25, 0.5)
#: What the query and the pipeline ask for.
FULL = {"bounded": True, "everywhere": True, "certain": CERTAIN}
#: Hash slots of disclosing terms: the bound of the one table that is broadcast.
SLOTS = 1 << 20
_BLOCK = 256
_RUN = 64
_ADDED = {"general": 4, "remove": 5}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running ``join`` from 0 before each of ``values``, and the whole one at the end.

    In two levels, blocks of ``_RUN`` and the blocks' totals: an array that grows by one costs
    a copy of itself, so one level would be quadratic in a text's matches."""
    def grown(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda out, x: F.concat(
            out, F.array(join(F.element_at(out, -1), x))))

    def shifted(blocks: Column) -> Column:
        return _let(grown(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda before: F.concat(
            F.flatten(F.transform(blocks, lambda b, i: F.transform(
                F.slice(b, F.lit(1), F.size(b) - 1), lambda x: join(before[i], x)))),
            F.slice(before, -1, 1)))

    many = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _RUN).cast("int"))
    return _let(F.transform(many, lambda b: grown(F.slice(values, b * _RUN + 1, F.lit(_RUN)))), shifted)


def _matches(text: Column, pattern: str, around: int | None = None,
             valid: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value[, before, after]).

    Places come from the lengths of the pieces between the matches; ``before`` and
    ``after`` are the ends of the neighbouring pieces.  Matches that are not ``valid``
    are left out.
    """
    kind = "array<struct<start:int,end:int,value:string" + (
        ",before:string,after:string" if around is not None else "") + ">>"
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                    F.split(text, pattern, -1).alias("p"))

    def placed(b: Column) -> Column:
        def item(ends: Column, m: Column, i: Column) -> Column:
            cells = [(ends[i] + F.length(b["p"][i])).alias("start"), ends[i + 1].alias("end"),
                     m.alias("value")]
            if around is not None:
                cells += [F.right(b["p"][i], F.lit(around)).alias("before"),
                          F.left(b["p"][i + 1], F.lit(around)).alias("after")]
            return F.struct(*cells)

        sizes = F.transform(b["m"], lambda m, i: F.length(b["p"][i]) + F.length(m))
        return F.when(F.size(b["m"]) > 0, _let(
            _let(sizes, lambda v: _running(v, lambda x, y: x + y)),
            lambda ends: F.transform(b["m"], lambda m, i: item(ends, m, i))))

    out = F.coalesce(_let(both, placed), F.array().cast(kind))
    return out if valid is None else F.filter(out, lambda m: valid(m["value"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(backwards, i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    return {"email": F.lit(True),
            "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
            "card": F.when(size.between(14, 19), _luhn(_digits(value))).otherwise(False),
            "phone": size.between(10, 15)}[kind]


def _mentions(hits: Column, kind: str, number: int) -> Column:
    """Matches as (start, kind_no, end, kind, value, before, after)."""
    return F.transform(hits, lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"),
        F.lit(kind).alias("kind"), m["value"].alias("value"), m["before"].alias("before"),
        m["after"].alias("after")))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version and base: sorted (start, kind_no, end, kind, value, before, after)."""
    d = docs.select(F.col(id_col).alias("doc_id"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gates = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for number, kind in enumerate(KINDS):
        hits = _matches(F.col("text"), PATTERNS[kind], CONTEXT + 1, partial(_valid, kind))
        hits = _mentions(hits, kind, number)
        d = d.withColumn(f"_{kind}", F.when(gates[kind], hits) if kind in gates else hits)
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,value:string,"
                           "before:string,after:string>>")
    return d.select("doc_id", F.xxhash64("text").alias("version"), F.sort_array(F.concat(
        *[F.coalesce(f"_{k}", empty) for k in KINDS])).alias("base"))


def _nearby(mention: Column) -> Column:
    """Terms around a mention: array of (term, start, end) in places of the whole text."""
    space = r"\x20\x09-\x0D"
    cut_before = F.when(F.length(mention["before"]) > CONTEXT, F.regexp_replace(
        mention["before"], rf"^[^{space}]*", "")).otherwise(mention["before"])
    cut_after = F.when(F.length(mention["after"]) > CONTEXT, F.regexp_replace(
        mention["after"], rf"[^{space}]*$", "")).otherwise(mention["after"])
    left = mention["start"] - F.length(cut_before)

    def rows(text: Column, shift: Column) -> Column:
        return F.transform(_matches(text, TERM), lambda t: F.struct(
            F.lower(t["value"]).alias("term"), (t["start"] + shift).alias("start"),
            (t["end"] + shift).alias("end"), t["value"].alias("word")))

    return F.concat(rows(cut_before, left), rows(cut_after, mention["end"]))


def _lower_bound(hits: Column, n: Column, z: float = CONFIDENCE_Z) -> Column:
    """Lower end of Wilson's interval for the share hits / n."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS))


def _all_places(docs: DataFrame, scored: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, added): every place of the ``scored`` terms in ``docs``."""
    terms = stage(scored.groupBy("term").agg(F.max("gone").alias("gone")), "pii-terms-scored")
    slots = terms.select(_slot(F.col("term")).alias("slot")).distinct()  # SLOTS rows at most
    d = docs.select(F.col(id_col).alias("doc_id"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = d.select("doc_id", F.xxhash64("text").alias("version"),
                     F.explode(_matches(F.col("text"), TERM)).alias("w")).select(
        "doc_id", "version", "w.start", "w.end", "w.value", F.lower("w.value").alias("term"))
    held = words.withColumn("slot", _slot(F.col("term"))).join(
        F.broadcast(slots), "slot", "left_semi").join(terms.hint("merge"), "term")
    span = F.struct("start", F.when(F.col("gone"), _ADDED["remove"]).otherwise(_ADDED["general"])
                    .alias("kind_no"), "end",
                    F.when(F.col("gone"), "remove").otherwise("general").alias("kind"), "value")
    return held.groupBy("doc_id", "version").agg(F.collect_set(span).alias("added"))


def disclosing_spans(docs: DataFrame, base: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE,
                     remove: float = REMOVE, bounded: bool = False, everywhere: bool = False,
                     certain: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(doc_id, version, added): spans of terms that disclose an entity of their document.

    ``bounded`` scores every pair by the lower bound, and ``support`` counts for nothing;
    ``certain`` asks for a least bound; ``everywhere`` marks all places of a term in all
    documents.
    """
    near = base.select("doc_id", "version", F.explode("base").alias("m")).select(
        "doc_id", "version", F.concat_ws(":", "m.kind", F.lower("m.value")).alias("entity"),
        F.explode(_nearby(F.col("m"))).alias("t")).select(
        "doc_id", "version", "entity", "t.term", "t.start", "t.end", "t.word")
    near = stage(near, "pii-terms")
    pairs = near.groupBy("entity", "term", "doc_id", "version").count().groupBy(
        "entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where(
        F.col("n_te") >= (1 if bounded else support))
    pairs = stage(pairs, "pii-pairs")
    entities = base.select("doc_id", "version", F.explode(F.array_distinct(F.transform(
        "base", lambda m: F.concat_ws(":", m["kind"], F.lower(m["value"]))))).alias("entity")) \
        .groupBy("entity", "doc_id", "version").count().groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_e"))
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = texts.select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    # counted first, then joined: a join below the count would meet every occurrence
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(
        pairs.select("term").distinct().hint("merge"), "term")
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    ic = F.log2(F.col("n") / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    # a mention can cut a word, so that its piece is near it more often than it is a word
    sure = _lower_bound(F.least("n_te", "n_t"), F.col("n_t"))
    if bounded:
        pmi = F.log2(sure * F.col("n") / F.col("n_e"))
    scored = (pairs.join(entities.hint("merge"), "entity").join(counts.hint("merge"), "term")
              .crossJoin(F.broadcast(total))  # one row
              .withColumn("disclosure", F.when(ic > 0, pmi / ic)).withColumn("sure", sure)
              .where((F.col("disclosure") >= generalise) & (F.col("sure") >= certain[0]))
              .select("entity", "term", ((F.col("disclosure") >= remove)
                                         & (F.col("sure") >= certain[1])).alias("gone")))
    scored = stage(scored, "pii-disclosing")
    if everywhere:
        return _all_places(docs, scored, id_col, text_col)
    kind = F.when(F.col("gone"), F.lit("remove")).otherwise(F.lit("general"))
    number = F.when(F.col("gone"), F.lit(_ADDED["remove"])).otherwise(F.lit(_ADDED["general"]))
    return near.join(scored.hint("merge"), ["entity", "term"]).groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("start", number.alias("kind_no"), "end", kind.alias("kind"),
                               F.col("word").alias("value"))).alias("added"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **thresholds) -> DataFrame:
    """One row per document: doc_id, version, base and spans, arrays of
    (start, kind_no, end, kind, value) sorted by start, then kind.

    ``version`` is xxhash64 of the text.  Added spans that overlap a base span are left
    out; of overlapping added spans both stay.
    """
    base = stage(base_spans(docs, id_col, text_col), "pii-base")
    added = stage(disclosing_spans(docs, base, id_col, text_col, **thresholds), "pii-added").toDF(
        "_id", "_version", "added")
    plain = F.transform("base", lambda m: F.struct(*[m[c].alias(c) for c in (
        "start", "kind_no", "end", "kind", "value")]))
    d = base.join(added.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))
                  & (F.col("version") == F.col("_version")), "left").select(
        "doc_id", "version", plain.alias("base"), "added")
    free = F.filter(F.coalesce("added", F.slice("base", 1, 0)), lambda a: ~F.exists(
        "base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return d.select("doc_id", "version", "base",
                    F.sort_array(F.concat("base", free)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def _label(s: Column) -> Column:
    word = F.when(s["value"].rlike(r"^\p{N}+$"), "[NUMBER]").when(
        s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return F.when(s["kind"] == "remove", "").when(s["kind"] == "general", word).otherwise(
        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def _merged(spans: Column) -> Column:
    """Overlapping spans become one (start, end, label), with the first one's label."""
    def cut(reach: Column) -> Column:  # the farthest end before each span
        def whole(firsts: Column) -> Column:
            return F.transform(firsts, lambda i, k: F.struct(
                spans[i]["start"].alias("start"),
                reach[F.coalesce(F.get(firsts, k + 1), F.size(spans))].alias("end"),
                _label(spans[i]).alias("label")))

        return _let(F.filter(F.sequence(F.lit(0), F.size(spans) - 1),
                             lambda i: spans[i]["start"] >= reach[i]), whole)

    return _let(_let(F.transform(spans, lambda s: s["end"]),
                     lambda ends: _running(ends, F.greatest)), cut)


def _cut(blocks: Column, begin: Column, end: Column) -> Column:
    """Characters begin..end of a text held as blocks of ``_BLOCK`` characters."""
    def part(j: Column) -> Column:
        low = F.greatest(begin - j * _BLOCK, F.lit(0))
        return F.substr(blocks[j], low + 1, F.least(end - j * _BLOCK, F.lit(_BLOCK)) - low)

    first, last = F.floor(begin / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")
    return F.when(end > begin, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **thresholds) -> DataFrame:
    """``docs`` with the found spans replaced in ``text_col``; other columns as they are."""
    found = stage(find_spans(docs, id_col, text_col, **thresholds).where(F.size("spans") > 0)
                  .groupBy(F.col("doc_id").alias("_pii_id"), F.col("version").alias("_pii_version"))
                  .agg(F.min("spans").alias("_pii_spans")), "pii-spans")
    d = docs.withColumn("_pii_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # the spans grow with the corpus: a merge join at every size
    d = d.join(found.hint("merge"), F.col(id_col).eqNullSafe(F.col("_pii_id"))
               & (F.xxhash64("_pii_text") == F.col("_pii_version")), "left")
    has = F.col("_pii_spans").isNotNull()
    d = d.withColumn("_pii_merged", F.when(has, _merged(F.col("_pii_spans"))))
    d = d.withColumn("_pii_blocks", F.when(has, F.regexp_extract_all(
        "_pii_text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))))
    merged, blocks = F.col("_pii_merged"), F.col("_pii_blocks")
    pieces = F.transform(merged, lambda s, i: F.concat(_cut(
        blocks, F.when(i > 0, F.try_element_at(merged, F.greatest(i, F.lit(1)))["end"]).otherwise(0),
        s["start"]), s["label"]))
    tail = _cut(blocks, F.element_at(merged, -1)["end"], F.length("_pii_text"))
    clean = F.when(has, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text_col))
    return d.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
