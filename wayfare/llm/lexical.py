"""Ranked lexical search: a document-at-a-time merge over compressed postings, shard by shard.

**Index.** A task cuts its documents into shards of about ``SHARD`` bytes of text. Within a shard, documents are numbered in
the order of doc_id, and each term has its postings in that order: gaps between numbers and occurrences as variable-length
integers. A shard also has a head: ids and numbers of terms of its documents. Writing the index shuffles nothing; the
documents that hold a term over all shards are summed afterwards, for the terms that are asked for.

**Search.** Postings of the queries' terms go to their shard's task. There each query merges its lists with a heap of
cursors, one document after another, and keeps its ``k`` best in a bounded heap ordered by score, then doc_id. A list
whose greatest contribution, together with those of the lists below it, can't lift a document to the worst of the kept ones
leaves the merge: its postings are looked up for the documents that the others found, as long as their bounds allow. The
bounds only leave out documents that score less than k others, so results are exact. The merge runs in windows of
documents, small ones first, since the bounds are weak until k documents are known. The best of all tasks are merged by
a window over (query, score, doc_id).

Terms are maximal runs outside ASCII punctuation, space and control characters; only A-Z are folded. Scores are integers:
a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document gets times * w * (10^9 tf div (1000 tf + 12 m)) with
m = 75 + (25 n N) div L.

Defined results: null and empty texts hold no term, never score, and are not counted in N. Rows with the same doc_id are
documents of their own; a null doc_id stands behind all others where scores are equal. Rows with the same item_id (null
included) are one query, their terms together; a query without known terms has no row. No documents or no queries give no
rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import FOLD, offsets_and_bytes, small_batches

#: Bytes of text and documents of a shard, at most (a longer text is a shard of its own).
SHARD, SHARD_DOCS = 8 << 20, 1 << 16
#: Queries whose postings one task holds, and distinct terms up to which they are broadcast to the index.
QUERIES, BROADCAST_TERMS = 1_000, 200_000
#: Documents of the first window; each window is twice as long as the one before.
WINDOW = 256
IN_TERM = np.ones(256, bool)
IN_TERM[:128] = [chr(c).isascii() and chr(c).isalnum() for c in range(128)]
LETTER = FOLD.astype(np.uint8)
INDEX = "shard long, term string, df long, postings binary, docs long, terms long, ids array<long>, lengths array<long>"


def terms(column: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of a column's texts in order, and the number of terms of each text."""
    off, data = offsets_and_bytes(column)
    bounds, data = off - off[0], LETTER[data[off[0] : off[-1]]]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IN_TERM[data]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside[:-1]
    after[bounds] = False  # a text begins anew
    starts = np.flatnonzero(inside & ~after)
    # A term ends where the next byte is outside or starts a text; counted by starts, so bytes of terms stand together.
    firsts = np.concatenate([[0], np.cumsum(inside)])
    cuts = np.concatenate([firsts[starts], firsts[-1:]])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[inside[:-1]]))
    return found, np.diff(np.searchsorted(starts, bounds))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits each, the low ones first, the last byte below 128; and where each ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        long = size > k
        more = (size[long] > k + 1).astype(np.uint8) << 7
        out[ends[long] - size[long] + k] = (values[long] >> 7 * k & 127).astype(np.uint8) | more
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The integers that ``packed`` wrote."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, last + 1 - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def _shard(rows: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """The head and the postings of one shard."""
    table = pa.Table.from_batches(rows)
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
    found, lengths = terms(table.column("text"))
    coded = found.dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), len(lengths)
    pairs, tf = np.unique(code * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, at = np.divmod(pairs, n)
    new = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
    gap = np.where(new, at + 1, at - np.concatenate([[0], at[:-1]]))
    data, ends = packed(np.stack([gap, tf], axis=1).ravel())
    firsts = np.flatnonzero(new)
    df = np.diff(np.concatenate([firsts, [len(term)]]))
    cuts = np.concatenate([[0], ends[2 * (firsts + df) - 1]]).astype(np.int32)
    held, kind = len(df), lambda x, t: pa.nulls(x, t)
    lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column("doc_id").combine_chunks().cast(pa.int64()))
    counts = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(lengths, pa.int64()))
    names = ["shard", "term", "df", "postings", "docs", "terms", "ids", "lengths"]
    head = [
        pa.array([number], pa.int64()), kind(1, pa.string()), kind(1, pa.int64()), kind(1, pa.binary()), pa.array([int((lengths > 0).sum())], pa.int64()),
        pa.array([int(lengths.sum())], pa.int64()), lists, counts
    ]
    yield pa.RecordBatch.from_arrays(head, names)
    body = [
        pa.array(np.full(held, number), pa.int64()), coded.dictionary.cast(pa.string()), pa.array(df, pa.int64()),
        pa.BinaryArray.from_buffers(pa.binary(), held, [None, pa.py_buffer(cuts), pa.py_buffer(data)]), kind(held, pa.int64()), kind(held, pa.int64()),
        kind(held, lists.type), kind(held, lists.type)
    ]
    yield pa.RecordBatch.from_arrays(body, names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, rows, size, docs = TaskContext.get().partitionId(), 0, [], 0, 0
    for batch in small_batches(batches, most=SHARD // 8):
        off, _ = offsets_and_bytes(batch.column("text"))
        rows.append(batch)
        size, docs = size + int(off[-1] - off[0]), docs + batch.num_rows
        if size >= SHARD or docs >= SHARD_DOCS:
            yield from _shard(rows, part << 32 | number)
            number, rows, size, docs = number + 1, [], 0, 0
    if rows:
        yield from _shard(rows, part << 32 | number)


def build_index(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The written index: for each shard a head and a row for each term."""
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return scratch.keep(rows.mapInArrow(_index, INDEX), "index")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found, lengths = terms(batch.column("text"))
        item = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
        yield pa.RecordBatch.from_arrays([item, found.cast(pa.string())], ["item_id", "term"])


class Best:
    """The k best documents of a query so far: a heap with the worst of them on top."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """A document that scores less can't come in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc: int | None) -> None:
        entry = (score, -doc if doc is not None else -(1 << 64))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


class Postings(NamedTuple):
    """A term's list in a shard: document numbers, what each gets from the term, and the most that any gets."""

    at: np.ndarray
    gain: np.ndarray
    most: int


def merged(lists: list[Postings]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of some lists in order, with their sums, by a heap of cursors."""
    cursors = [zip(p.at.tolist(), p.gain.tolist(), strict=True) for p in lists]
    docs, sums, last, total = [], [], -1, 0
    for doc, gain in heapq.merge(*cursors):
        if doc != last:
            docs.append(last)
            sums.append(total)
            last, total = doc, 0
        total += gain
    return np.array([*docs[1:], last][: len(docs)], np.int64), np.array([*sums[1:], total][: len(docs)], np.int64)


def rank(lists: list[Postings], ids: list[int | None], best: Best) -> None:
    """Offers the documents of a shard to a query's heap. ``lists``: a list for each of its terms, repeats in the gains."""
    lists = sorted((p for p in lists if p.most), key=lambda p: p.most)
    reach = np.cumsum([p.most for p in lists])  # the most that a list and those below it give
    low, width = 0, WINDOW
    while low < len(ids) and lists:
        high = min(low + width, len(ids))
        cut = [slice(*np.searchsorted(p.at, (low, high))) for p in lists]
        part = [Postings(p.at[c], p.gain[c], p.most) for p, c in zip(lists, cut, strict=True)]
        few = int(np.searchsorted(reach, best.least))  # lists that can't reach the heap by themselves
        docs, sums = merged(part[few:])
        for k in range(few - 1, -1, -1):
            alive = sums + reach[k] >= best.least
            docs, sums = docs[alive], sums[alive]
            at = np.searchsorted(part[k].at, docs)
            at[at == len(part[k].at)] = 0
            if len(docs) and len(part[k].at):
                sums = sums + np.where(part[k].at[at] == docs, part[k].gain[at], 0)
        for doc, score in zip(docs.tolist(), sums.tolist(), strict=True):
            if score >= best.least:
                best.offer(score, ids[doc])
        low, width = high, 2 * width


def _search(k: int, n_docs: int, n_terms: int):
    """A task's function over rows sorted by (shard, block), a shard's head first."""

    def ranked(rows: list[pa.RecordBatch], best: dict[int | None, Best]) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, lengths = table.column("ids")[0].as_py(), np.array(table.column("lengths")[0].as_py(), np.int64)
        m = 75 + np.array([25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        body = table.slice(1)
        df, weight = body.column("df").to_numpy(), body.column("weight").to_numpy()
        blobs = body.column("postings").combine_chunks()
        off, data = offsets_and_bytes(blobs)
        values = unpacked(data[off[0] : off[-1]]).reshape(-1, 2)
        of_item: dict[int | None, list[Postings]] = {}
        first = 0
        for i, uses in enumerate(body.column("uses").to_pylist()):
            part = values[first : first + df[i]]
            first += int(df[i])
            at, tf = np.cumsum(part[:, 0]) - 1, part[:, 1]
            gain = int(weight[i]) * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))
            for use in uses:
                p = Postings(at, gain if use["times"] == 1 else gain * use["times"], int(gain.max()) * use["times"])
                of_item.setdefault(use["item_id"], []).append(p)
        for item, lists in of_item.items():
            rank(lists, ids, best.setdefault(item, Best(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int | None, Best] = {}
        held: list[pa.RecordBatch] = []
        for batch in batches:
            heads = np.flatnonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False)).tolist()
            cuts = [0, *heads, batch.num_rows]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if i and held:
                    ranked(held, best)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            ranked(held, best)
        found = [(item, None if d == -(1 << 64) else -d, s) for item, x in best.items() for s, d in x.heap]
        columns = [pa.array([row[j] for row in found], pa.int64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return run


def search(documents: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` documents of highest positive score for each query: item_id, rank, doc_id, score."""
    scratch = Scratch(documents.sparkSession, "lexical")
    index = build_index(documents, scratch)
    asked = queries.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_query_terms, "item_id long, term string")
    asked = scratch.keep(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    totals = index.agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 1
    n_asked, n_items = asked.agg(F.count_distinct("term"), F.count_distinct(F.struct("item_id"))).first()
    few = F.broadcast if n_asked <= BROADCAST_TERMS else lambda df: df
    postings = index.where("term is not null").select("shard", "term", "df", "postings")
    counts = postings.join(few(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("all"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("all") + 1))).alias("weight")
    blocks = -(-n_items // QUERIES) or 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    uses = asked.join(counts.select("term", weight), "term").groupBy("term", "weight", block).agg(
        F.collect_list(F.struct("item_id", "times")).alias("uses")
    )
    uses = scratch.keep(uses, "uses")  # at most QUERIES items in a list
    body = postings.join(few(uses), "term")
    heads = index.where("ids is not null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ids", "lengths")
    both = heads.unionByName(body, allowMissingColumns=True).repartition("shard", "block")
    both = both.sortWithinPartitions("shard", "block", F.isnull("ids"))
    best = both.mapInArrow(_search(k, n_docs, n_terms), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
