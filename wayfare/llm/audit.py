"""How five filters of documents interact: what each removes, in every order.

The filters: A too few words, B too few distinct words, C too many capitals, D a symbol, E a text that a document of
smaller doc_id has. Words are exploded and counted by (document, word), then by document, which gives totals and distinct
words; the other flags meet them by an outer join. A document's five verdicts make a number from 0 to 31, and 32
conditional counts by part and label hold all that the 120 orders ask for: what a filter removes at a step are the counts
of the numbers that have its bit and none of the bits before.

Texts are dealt once, before words are exploded: the words of a document then stand in one partition, and both counts need
no further shuffle. Equal texts meet by their SHA-256, of which only the least doc_id is kept.

Defined results: a null text is empty (fails A only, and E if a smaller doc_id's text is null or empty); a null lang is
the part ''. Rows with the same doc_id are documents of their own, of which none is smaller than the other; a null doc_id
has no label and nothing is smaller than it. Several labels of one doc_id count as set if any is. No documents give no
rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
SPACE = r"[ \t-\r]+"
MASKS = 1 << len(FILTERS)


def word_counts(docs: DataFrame) -> DataFrame:
    """Words and distinct words (n_words, n_distinct) by the document's key (k1, k2); no row for a text without words."""
    dealt = docs.select("k1", "k2", "text").repartition("k1", "k2")
    words = dealt.select("k1", "k2", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    each = words.groupBy("k1", "k2", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("k1", "k2").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def verdicts(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each document: doc_id, part and whether it fails each filter (fails_a to fails_e)."""
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("k1"),
        F.xxhash64("doc_id", text).alias("k2")
    )
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = keyed.select(
        "doc_id", "part", "k1", "k2", (100 * capitals > CAPITALS_PERCENT * F.length("text")).alias("fails_c"),
        F.col("text").rlike(SYMBOLS).alias("fails_d"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    flags = scratch.keep(flags, "flags")
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = scratch.keep(first, "first")  # both sides of the join are then plain exchanges, which Spark splits where a text is frequent
    flags = flags.join(first, "digest", "left").withColumn("fails_e", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    flags = flags.select("doc_id", "part", "k1", "k2", "fails_c", "fails_d", "fails_e")
    both = flags.join(word_counts(keyed), ["k1", "k2"], "left")
    # Rows that agree in doc_id and text share a key, and their words were counted together.
    alike = F.count(F.lit(1)).over(Window.partitionBy("k1", "k2"))
    words, distinct = F.coalesce("n_words", F.lit(0)) / alike, F.coalesce("n_distinct", F.lit(0))
    return both.select(
        "doc_id", "part", (words < MIN_WORDS).alias("fails_a"), (100 * distinct < DISTINCT_PERCENT * words).alias("fails_b"), "fails_c", "fails_d", "fails_e"
    )


def conditional_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """By part: arrays docs, good and toxic of 32 counts, one for each set of filters that a document fails."""
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    mask = sum((F.col(f"fails_{c.lower()}").cast("int") * (1 << i) for i, c in enumerate(FILTERS)), F.lit(0))
    rows = failed.select("doc_id", "part", mask.alias("mask")).join(marks.where("good or toxic"), "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    counts = rows.groupBy("part", flag("good"), flag("toxic")).agg(*[F.count_if(F.col("mask") == m).alias(f"n{m}") for m in range(MASKS)])
    under = lambda *which: F.array(*[F.sum(F.when(which[0], F.col(f"n{m}")).otherwise(0)) for m in range(MASKS)])
    return counts.groupBy("part").agg(under(F.lit(True)).alias("docs"), under(F.col("good")).alias("good"), under(F.col("toxic")).alias("toxic"))


def _total(counts: str, wanted) -> Column:
    """The sum of the counts whose mask is wanted."""
    return F.aggregate(F.transform(counts, lambda n, m: F.when(wanted(m), n).otherwise(0)), F.lit(0).cast("long"), lambda s, n: s + n)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 a part."""
    scratch = Scratch(documents.sparkSession, "audit")
    counts = scratch.keep(conditional_counts(verdicts(documents, scratch), labels), "counts")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1))))
    steps = steps.withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    has = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: has(m) & ~gone(m)
    # Of the 120 orders, each filter that a document fails comes first among them equally often.
    orders_first = F.transform("docs", lambda n, m: F.when(has(m), n * F.call_function("div", F.lit(120), F.bit_count(m))).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", _total("docs", lambda m: ~has(m) & ~gone(m)).alias("kept"), _total("docs", removed).alias("removed"),
        _total("docs", lambda m: has(m) & gone(m)).alias("redundant"), _total("docs", lambda m: m == F.col("own")).alias("unique_fails"),
        _total("good", removed).alias("good_lost"), _total("toxic", removed).alias("toxic_lost"),
        F.aggregate(orders_first, F.lit(0).cast("long"), lambda s, n: s + n).alias("shapley")
    )
