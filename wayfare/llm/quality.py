"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose statistic reaches a cutoff. Cutoffs are not set by hand: documents with a quality label
are the holdout, and in each stratum (a language) an exact binomial test certifies which rules may be used together.

1. Path. A notch is a rule with one of its cutoffs. Documents labelled bad and documents without a label choose the
   notches that are worth it (they catch a share of the bad ones ``ENRICH`` times their share of the unlabelled, or more)
   and put them in order, the one that rejects the fewest unlabelled documents first, then the milder one. Documents labelled good have no
   part in this, so the path is fixed before any test.
2. Test. After each step of the path, the hypothesis "the rules so far together reject more than ``ALPHA`` of the good
   documents" is dropped if P(Binomial(n, ALPHA) <= k) is at most the stratum's share of ``DELTA`` (the exact
   Clopper-Pearson bound); n counts the stratum's good documents, k those that some rule so far rejects. The test is on
   the union, so the risk is not divided among rules, and along the path it stops at the first failure (fixed
   sequence), which needs no further correction.
3. Strata share ``DELTA`` (Bonferroni) among the largest number of them that have enough good documents to pass any test
   at that share; numbers of labels alone decide this, before any test. The other strata have no cutoffs.

With probability 1 - DELTA, no stratum then loses more than ALPHA of its good documents to the rules.

Defined results: a null text has no words and fails the base rule; a null language is a stratum of its own; a stratum
with too few good labels has no cutoffs and rejects by the base rule only; of several labels of a document the largest
counts; a null label is none. Repeated rows get equal results; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ALPHA, DELTA, ENRICH = 0.05, 0.05, 3
#: Cutoffs of each rule from the strictest to the mildest.
CUTOFFS = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0],
    "dup_lines_per_100_words": [0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0, 4.0, 8.0],
    "repeat_word_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "long_words": [5.5, 6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0, 16.0, 24.0],
    "short_words": [-5.5, -5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.5, -1.2],
}
#: Strata up to this number are broadcast (a row of cutoffs each).
BROADCAST_STRATA = 10_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in some 3-word window which occurs twice or more among the words."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w,
        i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    )

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return _let(
        F.sort_array(windows),
        lambda s: F.aggregate(
            places(s), start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"]
        )
    )


def text_statistics(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACES}]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    return F.struct(
        _let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                _repeat_words(w).cast("long").alias("n_repeat_words")
            )
        ).alias("w"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each document."""
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"),
        text_statistics(F.col("text").cast("string")).alias("s")
    )
    found = found.select("doc_id", "stratum", "s.w.n_words", "s.w.word_chars", "s.n_symbols", "s.n_dup_lines", "s.w.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _rule_values() -> dict[str, Column]:
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_100_words": F.lit(100.0) * F.col("n_dup_lines") / n,
        "repeat_word_share": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "short_words": -F.col("word_chars") / n,
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly in logarithms; 1 where k is not below n * p (no test passes there)."""
    import math

    ratio, first = math.log(p / (1 - p)), n * F.lit(math.log1p(-p))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + F.lit(ratio)
        top, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("sum"))

    start = F.struct(first.alias("term"), first.alias("sum"))
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step, lambda a: F.exp(a["sum"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).when(k <= 0, F.exp(first)).otherwise(F.least(more, F.lit(1.0)))


def _patterns(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that pass the base rule, counted by stratum, label (1, 0 or none) and number of cutoffs that each rule's
    statistic reaches: at most 11 ** 5 rows for each stratum and label, whatever the number of documents."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = features.where("not base_failed").join(marks.agg(F.max("quality").cast("int").alias("quality")), "doc_id", "left")
    values = _rule_values()
    reached = [sum((F.when(values[r] >= c, 1).otherwise(0) for c in cuts), F.lit(0)).alias(r) for r, cuts in CUTOFFS.items()]
    return marked.select("stratum", "quality", *reached).groupBy("stratum", "quality", *CUTOFFS).agg(F.count(F.lit(1)).alias("c"))


def path(patterns: DataFrame, enrich: int = ENRICH) -> DataFrame:
    """Rows (stratum, rule, pos, step): the notches of each stratum in order, chosen without documents labelled good."""
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("at")) for r in CUTOFFS]))
    other = patterns.where("quality is null or quality <> 1").withColumn("bad", F.col("quality").isNotNull())
    by_at = other.select("stratum", "bad", rules.alias("x"), "c").groupBy("stratum", "bad", "x.rule", "x.at").agg(F.sum("c").alias("c"))
    totals = by_at.groupBy("stratum", "rule").agg(*_by_label("all_bad", "all_none"))
    caught = by_at.where("at > 0").select("stratum", "bad", "rule", F.explode(F.expr("sequence(0, at - 1)")).alias("pos"), "c")
    caught = caught.groupBy("stratum", "rule", "pos").agg(*_by_label("bad", "none"))
    both = caught.join(
        totals.withColumnsRenamed({"stratum": "s", "rule": "r"}), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r"))
    )
    worth = both.where((F.col("bad") > 0) & (F.col("bad") * F.col("all_none") >= F.lit(enrich) * F.col("none") * F.col("all_bad")))
    order = Window.partitionBy("stratum").orderBy("none", F.desc("pos"), F.desc("bad"), "rule")
    return worth.select("stratum", "rule", "pos", F.row_number().over(order).alias("step"))


def _by_label(bad: str, none: str) -> list[Column]:
    return [F.sum(F.when(F.col("bad"), F.col("c")).otherwise(0)).alias(bad), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("c"))).alias(none)]


def tests(patterns: DataFrame, steps: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Rows (stratum, step, rule, pos, n_good, n_rejected, tail, certified) of the strata that are tested."""
    good = patterns.where("quality = 1")
    sizes = good.groupBy("stratum").agg(F.sum("c").alias("n_good"))
    # One row a stratum: the largest number of strata that can pass a test at that share of delta.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_good"), "stratum"))
    enough = F.col("n_good") * F.lit(_log1p(-alpha)) <= F.log(F.lit(delta) / F.col("rank"))
    sizes = sizes.withColumn("rank", rank).withColumn("strata", F.max(F.when(enough, F.col("rank"))).over(Window.partitionBy(F.lit(0))))
    sizes = sizes.where("rank <= strata").select("stratum", "n_good", "strata")
    lists = steps.groupBy(F.col("stratum").alias("s")).agg(F.sort_array(F.collect_list(F.struct("step", "rule", "pos"))).alias("steps"))  # 50 at most
    tested = sizes.join(lists, F.col("stratum").eqNullSafe(F.col("s"))).drop("s")
    at = F.create_map(*[x for r in CUTOFFS for x in (F.lit(r), F.col(r))])
    first = F.array_min(F.transform(F.filter("steps", lambda x: F.element_at(at, x["rule"]) > x["pos"]), lambda x: x["step"]))
    hits = good.join(tested.select(F.col("stratum").alias("s"), "steps"), F.col("stratum").eqNullSafe(F.col("s")))
    hits = hits.select("stratum", first.alias("first"), "c").where("first is not null").groupBy(F.col("stratum").alias("s"), "first").agg(
        F.sum("c").alias("c")
    )
    rows = tested.select("stratum", "n_good", "strata", F.explode("steps").alias("x")).select("stratum", "n_good", "strata", "x.*")
    rows = rows.join(hits, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("step") == F.col("first")), "left")
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n_rejected", F.sum(F.coalesce("c", F.lit(0))).over(so_far))
    rows = rows.withColumn("tail", binomial_tail(F.col("n_good"), F.col("n_rejected"), alpha))
    rows = rows.withColumn("certified", F.min(F.col("tail") <= F.lit(delta) / F.col("strata")).over(so_far))
    return rows.select("stratum", "step", "rule", "pos", "n_good", "n_rejected", "tail", "certified")


def _log1p(x: float) -> float:
    import math

    return math.log1p(x)


def thresholds(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Rows (stratum, rule, cutoff, n_good, n_rejected, tail) with the strictest certified cutoff of each rule; the last
    three are those of the step that brought it."""
    patterns = _patterns(features, labels)
    certified = tests(patterns, path(patterns), alpha, delta).where("certified")
    last = certified.groupBy("stratum", "rule").agg(F.max(F.struct("step", "pos", "n_good", "n_rejected", "tail")).alias("x"))
    grid = F.create_map(*[x for r, cuts in CUTOFFS.items() for x in (F.lit(r), F.array(*[F.lit(c) for c in cuts]))])
    cutoff = F.get(F.element_at(grid, F.col("rule")), F.col("x.pos"))
    return last.select("stratum", "rule", cutoff.alias("cutoff"), "x.n_good", "x.n_rejected", "x.tail")


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Documents (doc_id, text, lang) with their statistics, base_failed, kept and the rules that reject them."""
    scratch = Scratch(docs.sparkSession, "quality")
    features = scratch.keep(base_features(docs), "features")
    cuts = thresholds(features, labels, alpha, delta).groupBy(F.col("stratum").alias("s"))
    cuts = cuts.agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cuts = scratch.keep(cuts, "cutoffs")
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    found = features.join(cuts, F.col("stratum").eqNullSafe(F.col("s")), "left")
    hits = F.filter(F.array(*[F.when(v >= F.try_element_at("cuts", F.lit(r)), F.lit(r)) for r, v in _rule_values().items()]), lambda x: x.isNotNull())
    found = found.withColumn("rejected_by", F.coalesce(hits, F.array().cast("array<string>")))
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rejected_by"
    )
