"""Benchmark decontamination by spaced seeds.

Words (A-Z folded) of benchmark items and documents are hashed. A mask ignores some positions of a stretch of words; the
other words' hashes form a seed. The three masks find, by design, every stretch of ``WINDOW`` words that agrees with an
item in all but two words at most: for each way to place two differences, some mask hits (all 79 ways are tested). Each
hit names a diagonal of a document and an item. On it, words are compared one by one; a document overlaps an item if
``LEAST`` of ``WINDOW`` aligned words agree. Spans of overlapping stretches are returned.

With ``short``, as in the query and the pipeline, an item of fewer than ``WINDOW`` words overlaps if the same share of its
words agrees, rounded up: all but one of 6 to 11, all of 1 to 5. Its seeds are its first and its last half, of which one
difference leaves one whole, or all of its words. Without ``short``, all words of 6 to 11 have to agree, and shorter items
are ignored.

Test hashes are joined to training hashes. A benchmark of up to ``SEEDS`` seeds (counted first) is broadcast as one sorted
table, and the documents are read once and never shuffled. A larger one stays on the cluster: a sieve of fixed size is
broadcast, the documents' seeds that pass it meet the items' seeds in a join by hash, and each (document, item, diagonal)
is verified with the words of both. No hit is dropped, however often a seed occurs.

Defined results: null and empty texts overlap with nothing; a null doc_id or item_id stays null; repeated rows give
repeated results. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import hashed_words, mix, small_batches

MASKS = ("11101011", "101100111", "111111")
WINDOW, LEAST, SEEDS = 12, 10, 1_000_000
#: Bits of the sieve that is asked before the sorted seeds, of that before the join, and the bytes that it is sent in.
SIEVE, LARGE_SIEVE, STRIP = 22, 27, 1 << 16


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place of ``mask`` in a sequence of word hashes."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, MASKS.index(mask) + 1 if mask in MASKS else len(MASKS) + len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(out)


def item_seeds(words: np.ndarray, short: bool) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(mask, seeds, their places) of an item; a short item has its halves, or all of its words."""
    n = len(words)
    if not short or n >= WINDOW:
        return [(m, found, np.arange(len(found))) for m in MASKS if len(found := seeds(words, m))]
    size = n if n < 6 else n // 2
    at = np.unique([0, n - size])
    return [("1" * size, seeds(words, "1" * size)[at], at)] if n else []


def spans_on(item: np.ndarray, skipped: int, words: np.ndarray, short: bool) -> list[tuple[int, int, int]]:
    """(first, end, equal words) of the stretches of ``words`` that agree with an item: they lie along it, from its place
    ``skipped`` on."""
    width = min(WINDOW, len(item))
    if len(words) < width:
        return []
    equal = words == item[skipped : skipped + len(words)]
    total = np.concatenate([[0], np.cumsum(equal)])
    least = -(-LEAST * width // WINDOW) if short or width == WINDOW else width
    good = np.flatnonzero(total[width:] - total[:-width] >= least)
    if not len(good):
        return []
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > width) + 1):
        lo, hi = int(run[0]), int(run[-1]) + width
        out.append((lo, hi, int(total[hi] - total[lo])))
    return out


class Sieve:
    """The masks of all items, and which leading bits their seeds have."""

    def __init__(self, masks: list[str], bits: int):
        self.masks, self.bits = masks, bits
        self.table = np.zeros(1 << max(bits - 3, 0), np.uint8)

    def _at(self, found: np.ndarray) -> np.ndarray:
        return (found >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, found: np.ndarray) -> None:
        at = self._at(found)
        np.bitwise_or.at(self.table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def passing(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(seeds, places) of a document that may be an item's, for each mask."""
        out = []
        for mask in self.masks:
            found = seeds(words, mask)
            at = self._at(found)
            places = np.flatnonzero((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(places):
                out.append((found[places], places))
        return out


def _masks(sizes: set[int]) -> list[str]:
    return [*MASKS, *("1" * n for n in sorted(sizes) if "1" * n not in MASKS)]


class Seeds:
    """The seeds of some items: sorted hashes with item and place, a sieve before them, and the items' word hashes."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], short: bool = False):
        self.ids, self.items, self.short = [i for i, _ in items], [w for _, w in items], short
        parts = [(found, np.full(len(found), k), at, m) for k, w in enumerate(self.items) for m, found, at in item_seeds(w, short)]
        found, item, place = (np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (
            np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        )
        order = np.argsort(found, kind="stable")
        self.hash, self.item, self.place = found[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.sieve = Sieve(_masks({len(p[3]) for p in parts if p[3] not in MASKS}), SIEVE)
        self.sieve.add(self.hash)

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, first word, end word, equal words) of each overlapping span of a document."""
        diagonals = []
        for found, at in self.sieve.passing(words):
            lo, hi = np.searchsorted(self.hash, found, "left"), np.searchsorted(self.hash, found, "right")
            n = hi - lo
            if n.any():
                hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                diagonals.append(np.stack([self.item[hit], np.repeat(at, n) - self.place[hit]]))
        if not diagonals:
            return []
        out = []
        for k, shift in np.unique(np.concatenate(diagonals, axis=1), axis=1).T:
            from_item, from_doc = max(0, -int(shift)), max(0, int(shift))
            item = self.items[k]
            some = words[from_doc : from_doc + len(item) - from_item]
            out += [(int(k), from_doc + lo, from_doc + hi, equal) for lo, hi, equal in spans_on(item, from_item, some, self.short)]
        return out


SPAN = "doc_id long, item_id long, first_word long, end_word long, equal_words long"


def _items(benchmark: DataFrame, short: bool) -> DataFrame:
    """Items (item, item_id, words, seeds, places, masks): those with words enough, numbered, with all their seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches):
            kept, rows = [], []
            for i, words in hashed_words(batch.column("text")):
                parts = item_seeds(words, short) if len(words) >= (1 if short else 6) else []
                if parts:
                    kept.append(i)
                    found, at = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
                    rows.append((row, words.view(np.int64), found.view(np.int64), at, [len(p[0]) for p in parts if p[0] not in MASKS]))
                    row += 1
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(1, 5)]
            columns = [pa.array([r[0] for r in rows], pa.int64()), batch.column("item_id").take(pa.array(kept, pa.int64())), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "words", "seeds", "places", "masks"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, words array<long>, seeds array<long>, places array<long>, masks array<long>")


def _broadcast_table(items: DataFrame, short: bool) -> Seeds | None:
    """All items as one table, if they have ``SEEDS`` seeds at most."""
    if (items.agg(F.sum(F.size("seeds"))).first()[0] or 0) > SEEDS:
        return None
    rows = items.select("item_id", "words").collect()  # bounded: an item has a seed for each word or more
    return Seeds([(r.item_id, np.array(r.words, np.int64).view(np.uint64)) for r in rows], short)


def _joined(docs: DataFrame, items: DataFrame, short: bool, scratch: Scratch) -> DataFrame:
    """Spans (doc_id, text_hash, ...) by a join of seeds; ``docs`` (doc_id, text, text_hash)."""
    spark = docs.sparkSession
    sizes = items.select(F.explode("masks").alias("n")).distinct().collect()  # lengths under WINDOW
    sieve = Sieve(_masks({r.n for r in sizes}), LARGE_SIEVE)
    leading = F.explode(F.transform("seeds", lambda x: F.shiftrightunsigned(x, 64 - LARGE_SIEVE)))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << LARGE_SIEVE - 3, np.uint8)
        for batch in batches:
            at = batch.column("at").to_numpy()
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(own), STRIP):
            if own[k : k + STRIP].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([own[k : k + STRIP].tobytes()], pa.binary())], ["strip", "data"]
                )

    def either(table: pa.Table) -> pa.Table:
        found = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("data")])
        return pa.table({"strip": table.column("strip").slice(0, 1), "data": pa.array([found.tobytes()], pa.binary())})

    strips = items.select(leading.alias("at")).mapInArrow(bits, "strip long, data binary").groupBy("strip").applyInArrow(
        either, "strip long, data binary"
    )
    for r in strips.toLocalIterator():  # 2**LARGE_SIEVE bits, whatever the benchmark
        sieve.table[r.strip : r.strip + STRIP] = np.frombuffer(r.data, np.uint8)
    held = spark.sparkContext.broadcast(sieve)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches):
            kept, rows = [], []
            for i, words in hashed_words(batch.column("text")):
                if found := held.value.passing(words):
                    kept.append(i)
                    rows.append(
                        (row, words.view(np.int64), np.concatenate([x for x, _ in found]).view(np.int64), np.concatenate([x for _, x in found]))
                    )
                    row += 1
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(1, 4)]
            at = pa.array(kept, pa.int64())
            columns = [pa.array([r[0] for r in rows], pa.int64()), batch.column("doc_id").take(at), batch.column("text_hash").take(at), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "doc_id", "text_hash", "words", "seeds", "places"])

    near = scratch.keep(
        docs.mapInArrow(hits, "doc long, doc_id long, text_hash long, words array<long>, seeds array<long>, places array<long>"), "near"
    )
    pair = F.explode(F.arrays_zip("seeds", "places"))
    asked = near.select("doc", pair.alias("x")).select("doc", F.col("x.seeds").alias("seed"), F.col("x.places").alias("at"))
    known = items.select("item", pair.alias("x")).select("item", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    diagonals = asked.join(known, "seed").select("doc", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    rows = diagonals.join(near.select("doc", "doc_id", "text_hash", "words"), "doc").join(
        items.select("item", "item_id", F.col("words").alias("own")), "item"
    )
    start, skipped = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    part = F.slice("words", (start + 1).cast("int"), F.greatest(F.size("own") - skipped, F.lit(0)).cast("int"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, own, some = [], batch.column("own"), batch.column("part")
            for i, (start, skipped) in enumerate(zip(batch.column("start").to_pylist(), batch.column("skipped").to_pylist(), strict=True)):
                item, words = (np.array(x[i].values, np.int64).view(np.uint64) for x in (own, some))
                out += [(i, start + lo, start + hi, equal) for lo, hi, equal in spans_on(item, skipped, words, short)]
            at = pa.array([x[0] for x in out], pa.int64())
            columns = [
                *(batch.column(c).take(at) for c in ("doc_id", "text_hash", "item_id")),
                *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "item_id", "first_word", "end_word", "equal_words"])

    rows = rows.select("doc_id", "text_hash", "item_id", "own", part.alias("part"), start.alias("start"), skipped.alias("skipped"))
    return rows.mapInArrow(verify, "doc_id long, text_hash long, item_id long, first_word long, end_word long, equal_words long")


def overlaps(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """Spans (doc_id, item_id, first_word, end_word, equal_words) of documents (doc_id, text) that overlap items."""
    scratch = Scratch(docs.sparkSession, "seeds")
    items = scratch.keep(_items(benchmark, short), "items")
    table = _broadcast_table(items, short)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if table is None:
        return _joined(rows.withColumn("text_hash", F.xxhash64("text")), items, short, scratch).drop("text_hash")
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in small_batches(batches):
            ids, found = batch.column("doc_id"), []
            for i, words in hashed_words(batch.column("text")):
                found += [(i, *x) for x in table.overlaps(words)]
            at = pa.array([x[0] for x in found], pa.int64())
            columns = [
                ids.take(at), pa.array([table.ids[x[1]] for x in found], pa.int64()),
                *(pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4))
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first_word", "end_word", "equal_words"])

    return rows.mapInArrow(run, SPAN)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", short: bool = False) -> DataFrame:
    """The rows of ``docs`` without any overlap, with all their columns."""
    scratch = Scratch(docs.sparkSession, "seeds")
    items = scratch.keep(_items(benchmark, short), "items")
    table = _broadcast_table(items, short)
    if table is None:
        own = uuid.uuid4().hex[:8]  # names that no column of the input has
        narrow = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
        ).withColumn("text_hash", F.xxhash64("text"))
        hit = _joined(narrow, items, short, scratch).select(F.col("doc_id").alias(f"id_{own}"), F.col("text_hash").alias(f"hash_{own}")).distinct()
        hit = scratch.keep(hit, "hit")
        return docs.join(
            hit, docs.doc_id.cast("long").eqNullSafe(hit[f"id_{own}"]) & (F.xxhash64(docs[text].cast("string")) == hit[f"hash_{own}"]), "left_anti"
        )
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            yield batch.filter(pa.array([not held.value.overlaps(words) for _, words in hashed_words(batch.column(text))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
