"""Mixing sources to target weights by the cube method.

Every document has an expected number of copies, target / size of its source. The whole part is taken at once; the
fractional part is an inclusion probability. Flight phase: probabilities move along the null space of two balancing
constraints (number of documents, number of words), three units at a time, until two at most are fractional; each move
has mean zero, so inclusion probabilities hold. A flight runs in blocks of ``block`` units of one source; what a block
leaves open (two units, and ``RESERVE`` that it does not touch) goes on to the next level, where blocks hold ``block``
open units again, until one block per source is left. Its landing gives up the document constraint first, then rounds;
the words that rounding one long document adds or takes are then made good by exchanging a taken with an untaken unit of
that block whose sizes differ by as much. This last exchange is chosen by size, not by lot: a source's total comes out
right, and the probabilities of the units of its one last block hold only nearly.

No block ever holds more than about ``block`` rows, whatever the share of a source, and texts are never shuffled.

Defined results: a null text has size 0; documents without a source form a source of their own, last in order; repeated
rows are separate units; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 2048
RESERVE = 32
#: Sources up to this number are broadcast (each a row of about 100 bytes); beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Rows (source, source_size) to (source, source_size, target): shares of the total by weight, stopped at ``most``
    times a source's size, the excess reshared among the others by weight until none is above.

    The final level L (words for each unit of weight) is found in closed form: with sources in the order of
    ``most * size / weight``, the first k stop exactly when the level that is left for the others exceeds theirs.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1))
    ranked = ranked.withColumn("edge", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    before = every.orderBy("edge", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn(
        "level",
        (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    place = F.when(F.col("level") <= F.col("edge"), F.struct("edge", F.coalesce(F.col("source"), F.lit("\U0010ffff"))))
    level = level.withColumn("L", F.min_by("level", place).over(every))  # the first source that does not stop
    capped = F.lit(float(most)) * F.col("source_size")
    target = F.when(F.col("L").isNull() | (F.col("edge") < F.col("L")), capped).otherwise(F.least(F.col("w") * F.col("L"), capped))
    return level.select("source", "source_size", target.cast("double").alias("target"))


def _draw(a: int, b: int, c: int) -> float:
    """A number in [0, 1) from three integers, the same in every run."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 + c * 0x94D049BB133111EB + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> s)) * m) & 0xFFFFFFFFFFFFFFFF
    return (x >> 11) / 9007199254740992.0


def _move(p: list[float], u: list[float], r: float) -> None:
    """One step along +u or -u to the border of the cube, of mean zero; the coordinate at the border becomes 0 or 1."""
    ahead = back = math.inf
    for x, d in zip(p, u, strict=True):
        if d > 0:
            ahead, back = min(ahead, (1 - x) / d), min(back, x / d)
        elif d < 0:
            ahead, back = min(ahead, -x / d), min(back, -(1 - x) / d)
    step = ahead if r * (ahead + back) < back else -back
    for i, d in enumerate(u):
        p[i] += step * d
        if p[i] < 1e-9:
            p[i] = 0.0
        elif p[i] > 1 - 1e-9:
            p[i] = 1.0


def fly(p: np.ndarray, size: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """The flight of one block: all but two entries at most become 0 or 1, sums of p and of p * size stay as they are.
    With ``land`` the last two are rounded too, keeping the words as long as they can be kept."""
    start = p.astype(float)
    p, sizes, turn = start.tolist(), size.astype(float).tolist(), 0
    held: list[int] = []
    for i, x in enumerate(p if land else p[: max(0, len(p) - RESERVE)]):
        if not 0.0 < x < 1.0:
            continue
        held.append(i)
        if len(held) == 3:
            a, b, c = held
            u = [sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a]]
            if u[0] == u[1] == u[2] == 0:  # equal sizes: any direction that keeps the number of documents
                u = [1.0, -1.0, 0.0]
            top = max(map(abs, u))
            q = [p[a], p[b], p[c]]
            turn += 1
            _move(q, [x / top for x in u], _draw(seed, i, turn))
            p[a], p[b], p[c] = q
            held = [j for j in held if 0.0 < p[j] < 1.0]
            if len(held) == 3:  # pragma: no cover - a step always ends at the border
                held = held[1:]
    if land and len(held) == 2:
        a, b = held
        q, u = [p[a], p[b]], [sizes[b], -sizes[a]] if sizes[a] and sizes[b] else [1.0, -1.0]
        top = max(map(abs, u))
        _move(q, [x / top for x in u], _draw(seed, 1 << 40, 1))
        p[a], p[b] = q
        held = [j for j in held if 0.0 < p[j] < 1.0]
    if land:
        for j in held:
            p[j] = float(_draw(seed, 1 << 41, j) < p[j])
        return _exchange(start, np.array(p), size.astype(float))
    return np.array(p)


def _exchange(start: np.ndarray, p: np.ndarray, size: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Swaps a taken with an untaken unit, ``rounds`` times at most, each time the pair that brings sum(p * size) nearest
    to sum(start * size)."""
    free = (start > 0) & (start < 1)
    for _ in range(rounds):
        over = float(((p - start) * size).sum())
        taken, other = np.flatnonzero(free & (p == 1)), np.flatnonzero(free & (p == 0))
        if abs(over) < 0.5 or not len(taken) or not len(other):
            break
        other = other[np.argsort(size[other], kind="stable")]
        at = np.searchsorted(size[other], size[taken] - over)
        pairs = [
            (abs(over - size[i] + size[other[k]]), int(i), int(other[k])) for i,
            x in zip(taken, at, strict=True) for k in (x - 1, x) if 0 <= k < len(other)
        ]
        gap, i, j = min(pairs)
        if gap >= abs(over):
            break
        p[i], p[j] = 0.0, 1.0
    return p


def _flight(land: bool, seed: int):
    def run(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [(c, "ascending") for c in ("doc_id", "size", "number", "copies", "p")])
        table = table.take(order)
        block = table.column("block")[0].as_py() or 0
        size = table.column("size").to_numpy()
        p = fly(table.column("p").to_numpy(), size, seed + block * 7919 + len(size), land)
        done = (p == 0.0) | (p == 1.0)
        copies = table.column("copies").to_numpy() + np.where(done, p, 0).astype(np.int64)
        table = table.set_column(table.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
        table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(np.where(done, 0.0, p)))
        return table

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """Documents (doc_id, text, source) to (doc_id, source, size, source_size, target, copies, taken), one row each.

    ``taken`` is ``copies * size``; a source's taken words come near its target, and ``copies`` is at most ``most``.
    """
    return mix_units(docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size")), weights, most, block, seed)


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``copies``; rows that share doc_id and source
    are one unit and get the same number."""
    units = docs.select(
        "doc_id", "source", word_count(F.col("text").cast("string")).alias("size")
    ).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    own = uuid.uuid4().hex[:8]  # names that no column of the input has
    taken = mix_units(units, **options).where("copies > 0").select(*[F.col(c).alias(f"{c}_{own}") for c in ("doc_id", "source", "copies")])
    same = docs.doc_id.cast("long").eqNullSafe(taken[f"doc_id_{own}"]) & docs.source.cast("string").eqNullSafe(taken[f"source_{own}"])
    rows = docs.join(taken, same)
    return rows.select(*[docs[c] for c in docs.columns if c != "copies"], F.col(f"copies_{own}").alias("copies"))


def mix_units(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix of units (doc_id, source, size)."""
    spark = units.sparkSession
    scratch = Scratch(spark, "mix")
    narrow = units.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size")
    )
    narrow = scratch.keep(narrow.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    sizes = scratch.keep(sizes, "sources")
    goal = targets(sizes.select("source", "source_size"), weights, most).withColumnRenamed("source", "s")
    goal = goal.join(sizes.select(F.col("source").alias("s2"), "n"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    if sizes.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    # Repeated rows are numbered, so that they are dealt over all blocks.
    each = narrow.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    units = each.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share + F.lit(1e-9))
    units = units.withColumn("copies", whole.cast("long")).withColumn("p", F.greatest(share - whole, F.lit(0.0)))
    units = units.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    salt = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("size"), F.col("number"))
    units = units.withColumn("block", F.pmod(salt, F.ceil(F.col("n") / F.lit(block))))
    keep = ["doc_id", "source", "size", "number", "source_size", "target", "n", "copies", "p", "block"]
    units = units.select(*keep)
    level, most_n = 0, sizes.agg(F.max("n")).first()[0] or 0
    done = None
    while True:
        last = most_n <= block
        flown = units.groupBy("source", "block").applyInArrow(_flight(last, seed + 1009 * level), units.schema)
        flown = scratch.keep(flown, f"level{level}")
        closed = flown if last else flown.where("p = 0")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        left = F.ceil(F.col("n") / F.lit(block)) * (2 + RESERVE)  # the most that blocks leave open
        units = flown.where("p > 0").withColumn("n", left).withColumn(
            "block",
            F.pmod(
                F.xxhash64(F.lit(level), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("size"), F.col("number")), F.ceil(F.col("n") / F.lit(block))
            )
        )
        units, most_n, level = units.select(*keep), (2 + RESERVE) * math.ceil(most_n / block), level + 1
    return done.select("doc_id", "source", "size", "source_size", F.col("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
