"""Quality rules: decision lists learned by sequential covering, as Spark conditions.

Everything is DataFrame work.  ``text_stats`` computes the statistics of a text in
its own row (no shuffle).  ``learn`` covers the labelled bad rows rule by rule: a
rule grows by the threshold with the largest FOIL gain on the growing rows, is
pruned back to the prefix that does best on the pruning rows, and is accepted while
it is precise enough there; covered rows then leave.  Each step is one aggregate of
a histogram (feature, bin) over the labelled sample.  The result is an ordered
``CASE WHEN``: the first rule that holds names the reason.

Repeated windows are found by 64-bit hashes of five words inside one text.

Defined cases: null or empty text has no words and all counts zero, so it fails the
base test; labels other than 0 and 1 and labels without a document teach nothing;
of several labels of one document the lowest counts; without a bad label the list
is empty and the verdict is to keep; repeated rows are judged alike; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Labelled rows the list is learned from, at most (by hash of the id, so at random).
MAX_LABELLED = 20_000
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"
#: What the learned conditions may test: name -> expression over ``text_stats``.
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "distinct_share": "n_distinct_words / n_words",
    "chars_per_word": "word_chars / n_words",
}


def _window_hashes(words: Column) -> Column:
    """Hash of every 5-word window, in order."""
    return F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))).otherwise(
        F.array().cast("array<bigint>"))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and ``keep``) with n_words, word_chars, n_symbols, n_marks, n_lines,
    n_dup_lines, n_distinct_words and n_repeat_words of each whole text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), *keep,
                    F.col(text_col).cast("string").alias("_text"))
    d = d.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", lines).withColumn("_windows", _window_hashes(F.col("_words")))
    # (hash, place) sorted: equal windows lie side by side
    pairs = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_pairs", pairs)
    twice = F.filter("_pairs", lambda p, k: (
        (k > 0) & (F.try_element_at("_pairs", F.greatest(k, F.lit(1)))["h"] == p["h"]))
        | F.coalesce(F.try_element_at("_pairs", k + 2)["h"] == p["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda p: p["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"),
                              p.alias("last")), lambda s: s["n"])
    return d.select(
        "doc_id", *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias(
            "n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass
class DecisionList:
    """Ordered rules; a text is rejected by the first whose conditions all hold."""

    rules: list[list[Condition]] = field(default_factory=list)

    def sql(self) -> str:
        """Number of the first rule that holds, 0 for none."""
        if not self.rules:
            return "0"
        cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}"
                         for i, rule in enumerate(self.rules, 1))
        return f"CASE {cases} ELSE 0 END"

    def verdict(self) -> Column:
        return F.expr(self.sql())


def with_features(stats: DataFrame) -> DataFrame:
    """Add FEATURES; a share of nothing is zero."""
    return stats.select("*", *[F.coalesce(F.expr(e.replace(" / ", " / nullif(") + ", 0)"),
                                          F.lit(0.0)).cast("double").alias(n)
                               for n, e in FEATURES.items()])


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, bad) of at most ``limit`` labelled ids, picked by a hash of the id."""
    return (labels.where("quality in (0, 1) and doc_id is not null")
            .groupBy(F.col("doc_id").cast("long").alias("_labelled"))
            .agg((F.min("quality") == 0).cast("int").alias("bad"))
            .orderBy(F.xxhash64("_labelled"), "_labelled").limit(limit))


def _thresholds(train: DataFrame, steps: int) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature within either class."""
    shares = [i / steps for i in range(1, steps)]
    rows = train.groupBy("bad").agg(*[F.percentile_approx(f, shares, 10_000).alias(f)
                                      for f in FEATURES]).collect()  # two rows
    return {f: sorted({round(t, 6) for r in rows for t in r[f]}) for f in FEATURES}


def _bin(feature: str, thresholds: list[float]) -> Column:
    """How many of the thresholds the feature reaches."""
    cuts = F.array(*[F.lit(t) for t in thresholds]).cast("array<double>")
    return F.size(F.filter(cuts, lambda t: F.col(feature) >= t))


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, float, float] | None:
    """The condition with the largest FOIL gain on ``rows``; its bad and good counts."""
    names = list(FEATURES)
    hist = rows.select("bad", F.posexplode("bins").alias("feature", "bin")).groupBy(
        "feature", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    up = Window.partitionBy("feature").orderBy("bin")
    down = Window.partitionBy("feature").orderBy(F.desc("bin"))
    every = Window.partitionBy("feature")
    hist = hist.select("feature", "bin", F.sum("p").over(every).alias("all_p"),
                       F.sum("n").over(every).alias("all_n"),
                       F.sum("p").over(up).alias("p_lt"), F.sum("n").over(up).alias("n_lt"),
                       F.sum("p").over(down).alias("p_ge"), F.sum("n").over(down).alias("n_ge"))
    # bins 0..b (value < cut b) or bins b.. (value >= cut b - 1)
    sides = hist.select("all_p", "all_n", F.inline(F.array(
        F.struct("feature", F.lit(False).alias("ge"), (F.col("bin") + 1).alias("cut"),
                 F.col("p_lt").alias("p"), F.col("n_lt").alias("n")),
        F.struct("feature", F.lit(True).alias("ge"), F.col("bin").alias("cut"),
                 F.col("p_ge").alias("p"), F.col("n_ge").alias("n")))))
    gain = F.col("p") * (F.log2(F.col("p") / (F.col("p") + F.col("n")))
                         - F.log2(F.col("all_p") / (F.col("all_p") + F.col("all_n"))))
    top = (sides.where("p > 0 and cut >= 1").withColumn("gain", gain).where("gain > 1e-9")
           .orderBy(F.desc("gain"), F.desc("p"), "feature", "ge", "cut").limit(40).collect())
    for r in top:
        thresholds = cuts[names[r["feature"]]]
        if r["cut"] <= len(thresholds):
            return Condition(names[r["feature"]], r["ge"], thresholds[r["cut"] - 1]), r["p"], r["n"]
    return None


def learn(train: DataFrame, steps: int = 20, most_rules: int = 12, most_conditions: int = 3,
          precision: float = 0.95, least: int = 2) -> DecisionList:
    """Sequential covering of the rows with ``bad`` = 1; ``train`` has FEATURES, bad, doc_id.

    Each rule takes its candidate thresholds from the rows that are left."""
    left = stage(train.withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3))),
                 "labelled")
    found = DecisionList()
    for _ in range(most_rules):
        cuts = _thresholds(left, steps)
        bins = F.array(*[_bin(f, ts) for f, ts in cuts.items()])
        rule: list[Condition] = []
        rows = left.where("third > 0").withColumn("bins", bins)
        while len(rule) < most_conditions:
            best = _best(rows, cuts)
            if best is None:
                break
            condition, _, n = best
            rule.append(condition)
            rows = rows.where(condition.sql())
            if n == 0:
                break
        if not rule:
            break
        prefixes = [" AND ".join(c.sql() for c in rule[:k]) for k in range(1, len(rule) + 1)]
        tally = left.agg(*[F.coalesce(F.sum(F.expr(f"int({p} AND bad = {b} AND third {t})")),
                                      F.lit(0)).alias(f"{k}_{b}_{i}")
                           for k, p in enumerate(prefixes) for b in (1, 0)
                           for i, t in enumerate(("= 0", ">= 0"))]).first()

        def worth(k: int, tally=tally) -> float:
            p, n = tally[f"{k}_1_0"], tally[f"{k}_0_0"]
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(len(prefixes)), key=lambda i: (worth(i), -i))
        p, n = tally[f"{k}_1_1"], tally[f"{k}_0_1"]
        if p < least or p < precision * (p + n):
            break
        # of conditions on one side of a feature the last is the tightest
        found.rules.append(list({(c.feature, c.at_least): c for c in rule[:k + 1]}.values()))
        left = left.where(f"NOT ({prefixes[k]})")
    return found


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn a decision list from the labelled documents (at most ``max_labelled``)."""
    sample = labelled_sample(labels, max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), F.col("id") == F.col("_labelled"))
    train = stage(with_features(text_stats(rows, "id", "text", keep=("bad",)))
                  .select("doc_id", "bad", *FEATURES), "labelled")
    return learn(train)


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``text_stats`` with base_failed, rule (0: none) and kept of every document."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (with_features(text_stats(docs, id_col, text_col))
            .withColumn("base_failed", failed).withColumn("rule", rules.verdict())
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))
