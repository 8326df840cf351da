"""Near-duplicate documents by SimHash: fingerprints of 64 bits, linked where at most three bits differ.

Links are found by covering codes. Two fingerprints within ``THRESHOLD`` = 3 bits agree in one half of 32 bits up to
``NEAR`` = 1 bit. A half is 23 bits and 9 more; its anchors are the words of the perfect binary Golay code on the 23 bits,
with the 9 bits as they are: 2^21 anchors of covering radius 3. Each half has one anchor within that radius, its home. A
fingerprint goes to every anchor within covering radius plus threshold, bit places taken into account: to the homes of all
words that differ from the half in at most one bit (10 of them, 15 for the half of words that lie 3 from their home). So
one of two linked fingerprints meets the other at its home, and homes are compared with everything that came.

Equal fingerprints are one row before they are replicated. At an anchor, the fingerprints at home are held and the others
stream by; a task returns at most one link for each visitor and those that join two groups at home, never all pairs: the
components are the same. An anchor with more than ``HELD`` fingerprints at home is dealt over several tasks.

Defined results: words, shingles and hashes follow ``fingerprints``; a null or empty text, or one without words, has
fingerprint zero and is linked like any other. Rows with the same doc_id are documents of their own; a null doc_id is never
the smallest, and the component of nothing but nulls has null. An empty table gives an empty table. Other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._scratch import Scratch
from ._words import small_batches
from .components import components

SHINGLE, SEED, THRESHOLD, NEAR = 3, 42, 3, 1
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Fingerprints at home that one task holds for an anchor, and visitors compared with them at a time.
HELD, VISITORS = 16_384, 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = re.compile(rb"[ \t-\r]")
#: Bits set in each byte value, by bit place (the highest first).
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
GOLAY = 0b101011100011  # generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECKS = 23, 11
PLAIN = 32 - LENGTH


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece, cut at white space."""
    at = 0
    while at < len(text):
        gap = SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(LOWER).split()
        at = end


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    columns = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(columns[:, k], minlength=256) @ BITS for k in range(8)])


def fingerprint(text: bytes) -> int:
    """The SimHash of a text in UTF-8: a bit is 1 if it is set in over half of the XXH64 values of the text's 3-word
    shingles, A-Z folded, joined by one space, repeats included; with fewer words, of the whole sequence; 0 without words."""
    carried: list[bytes] = []
    ones, n = np.zeros(64, np.int64), 0
    for piece in _words(text):
        words = carried + piece
        joined, ends = memoryview(b" ".join(words)), np.cumsum([len(w) + 1 for w in words]) - 1
        first = [0, *(ends[:-1] + 1).tolist()]
        spans = zip(first, ends[SHINGLE - 1 :].tolist(), strict=False)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
        ones, n = ones + _ones(hashes), n + len(hashes)
        carried = words[-(SHINGLE - 1) :]
    if not n and carried:
        ones, n = _ones(np.array([xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = batch.column("text").cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "node"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and the fingerprint (node, as a signed long) of each document."""
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, node long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator: 0 for code words, the same for words of one coset."""
    words = words.astype(np.int64)
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        words = np.where(words >> k & 1, words ^ (GOLAY << k - CHECKS), words)
    return words


@cache
def cosets() -> tuple[np.ndarray, list[np.ndarray]]:
    """By syndrome: the one pattern of at most 3 bits, which leads from a word to its home, and the patterns of 4 bits, which
    lead to code words that are home to a neighbour."""
    patterns = [np.array([sum(1 << b for b in c) for c in combinations(range(LENGTH), w)], np.int64) for w in range(5)]
    leaders = np.zeros(1 << CHECKS, np.int64)
    near = np.concatenate(patterns[:4])
    leaders[syndrome(near)] = near
    at = syndrome(patterns[4])
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange((1 << CHECKS) + 1))
    return leaders, [patterns[4][order[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, visits, node): false at the node's homes, true at the other anchors it goes to."""
    leaders, next_ones = cosets()
    counts = np.array([len(x) for x in next_ones])
    flat, starts = np.concatenate(next_ones), np.concatenate([[0], np.cumsum(counts)])
    for batch in batches:
        node = batch.column("node").to_numpy()
        keys, visits, nodes = [], [], []
        for side in (0, 1):
            half = (node.view(np.uint64) >> np.uint64(32 * side)).astype(np.int64) & 0xFFFFFFFF
            word, plain, top = half >> PLAIN, half & (1 << PLAIN) - 1, np.int64(side << 32)
            s = syndrome(word)
            home = (word ^ leaders[s]) << PLAIN
            n = counts[s]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = (np.repeat(word, n) ^ flat[np.repeat(starts[s], n) + place]) << PLAIN | np.repeat(plain, n)
            flips = (home[:, None] | plain[:, None] ^ (1 << np.arange(PLAIN))).ravel()
            keys += [top | home | plain, top | flips, top | other]
            nodes += [node, np.repeat(node, PLAIN), np.repeat(node, n)]
            visits += [np.zeros(len(node), bool), np.ones(len(flips) + len(other), bool)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys)), pa.array(np.concatenate(visits)), pa.array(np.concatenate(nodes))], ["anchor", "visits", "node"]
        )


class Home:
    """The fingerprints at home at one anchor, in groups that are linked with each other."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.group = nodes, np.arange(len(nodes))

    def links(self, others: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A link for each of the others that has any, and links that unite groups."""
        a, b = [], []
        for i in range(0, len(others), VISITORS):
            some = others[i : i + VISITORS]
            near = np.bitwise_count((some[:, None] ^ self.nodes).view(np.uint64)) <= THRESHOLD
            met = np.flatnonzero(near.any(axis=1))
            first = near[met].argmax(axis=1)
            a.append(some[met])
            b.append(self.nodes[first])
            lowest, highest = (f(axis=1) for f in (np.where(near[met], self.group, len(self.group)).min, np.where(near[met], self.group, -1).max))
            for j in np.flatnonzero(lowest != highest).tolist():
                mine = np.unique(self.group[near[met[j]]])
                if len(mine) > 1:
                    a.append(np.full(len(mine) - 1, self.nodes[mine[0]]))
                    b.append(self.nodes[mine[1:]])
                    self.group[np.isin(self.group, mine)] = mine[0]
        return a, b


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, part, visits): links (a, b) of fingerprints within the threshold."""
    key, waiting, home = None, [], None  # of the anchor that is open: homes that came so far, and these ready to be met

    def meet(nodes: np.ndarray, out: tuple[list, list]) -> None:
        for side, found in zip(out, home.links(nodes), strict=True):
            side += found

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, part, visits, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part", "visits", "node"))
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
        ends, out = np.append(new[1:], len(node)), ([], [])
        goes_on = key == (anchor[0], part[0])
        homes = np.add.reduceat((~visits).astype(np.int64), new)
        homes[-1] = max(homes[-1], 2)  # may go on in the next batch
        if goes_on:
            homes[0] = max(homes[0], 2)
        # Most anchors have one row at home or none: those with one are compared together.
        alone = homes == 1
        rows = np.repeat(alone, ends - new)
        one = np.repeat(node[new[alone]], (ends - new)[alone])
        near = np.bitwise_count((node[rows] ^ one).view(np.uint64)) <= THRESHOLD
        out[0].append(node[rows][near])
        out[1].append(one[near])
        for i in np.flatnonzero(homes > 1).tolist():
            lo, hi = int(new[i]), int(ends[i])
            if i or not goes_on:
                if waiting:
                    home = Home(np.concatenate(waiting))
                    meet(home.nodes, out)
                key, waiting, home = (anchor[lo], part[lo]), [], None
            at = lo + int(np.searchsorted(visits[lo:hi], True))
            if at > lo:
                waiting.append(node[lo:at])
            if at < hi and (home or waiting):
                if waiting:
                    home, waiting = Home(np.concatenate(waiting)), []
                    meet(home.nodes, out)
                meet(node[at:hi], out)
        yield _edges(out)
    if waiting:
        home, out = Home(np.concatenate(waiting)), ([], [])
        meet(home.nodes, out)
        yield _edges(out)


def _edges(out: tuple[list, list]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *side]) for side in out)
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) of distinct fingerprints, enough for the components of all pairs within the threshold."""
    rows = nodes.select("node").mapInArrow(_replicated, "anchor long, visits boolean, node long")
    homes = rows.where("not visits").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HELD)
    # One row for HELD fingerprints at least: of 10^10 fingerprints at most 1.2 million rows, 20 MB.
    parts = scratch.keep(homes.select("anchor", F.ceil(F.col("n") / HELD).cast("int").alias("parts")), "parts")
    rows = rows.join(F.broadcast(parts), "anchor", "left")
    # With several parts, a fingerprint is at home in one of them and visits the others, too.
    all_parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    dealt = rows.select("anchor", "visits", "node", own.alias("own"), all_parts).withColumn("visits", F.col("visits") | (F.col("part") != F.col("own")))
    dealt = dealt.select("anchor", "part", "visits", "node").repartition("anchor", "part")
    sorted_rows = dealt.sortWithinPartitions("anchor", "part", "visits")
    return sorted_rows.mapInArrow(_compared, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Documents (doc_id) with fingerprint, as 16 hexadecimal digits, and component_id, the smallest doc_id reachable."""
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = scratch.keep(fingerprints(documents), "fingerprints")
    nodes = scratch.keep(docs.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, scratch), scratch, "links").withColumnRenamed("node", "linked")
    joined = nodes.join(found, nodes.node == found.linked, "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = scratch.keep(joined.join(least, "comp").select("node", "component_id"), "labels")
    return docs.join(labels, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
