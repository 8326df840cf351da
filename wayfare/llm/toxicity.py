"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training rows are labelled documents whose crc32(doc_id as text) mod 5 is not 0. In the order of a hash of doc_id, at most
``EXAMPLES`` of them with at most ``POSTINGS`` different terms in all are taken (a documented bound: the index is
broadcast, about 16 bytes a posting). A second hash deals one in four of them to the calibration fold; the others are the
examples of the index, toxic and clean ones alike.

Terms are lower-case words without outer punctuation. Every word of two or more examples is a term, whatever its label,
so practically every text has a vector. A term weighs (1 + ln tf) * idf * (sqrt(G) + ``FLOOR``), vectors have length 1. G
is the log-likelihood ratio of the term and the label among the examples of the index (the calibration fold has no part
in it): without that factor the cosine compares the vocabulary of texts, and their few telling words drown.

The index keeps postings by term and example, and the largest weight of each term in each block of ``LANE`` examples (the
``FREQUENT`` most frequent terms as full rows, whose sums are known exactly before any block is visited); examples that
are alike stand in one block (bisection along principal axes of random projections). A query sums these maxima to an
upper bound for each block, visits blocks by falling bound, and stops when no block can reach the k-th best cosine: the k
nearest examples are exact. They vote with weight cosine ** 2. Votes become scores by pooled adjacent
violators on the calibration fold, where an example of equal vector does not vote, and are interpolated between pools.
Neighbours are returned as evidence.

Defined results: a null or empty text, or one without any term, gets the rate of toxic ones among all examples. A null
doc_id counts as an empty text for the split and is never an example. Of several labels of a document the largest counts,
of several texts the least; null labels are none. Without toxic examples no document is toxic. Equal cosines are ordered
by the examples' place in the index. Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import small_batches

EXAMPLES, POSTINGS, FOLDS = 6000, 4_000_000, 4
LEAST_DF, FLOOR, LANE, NEIGHBOURS, FIRST_BLOCKS, AXES = 2, 0.1, 64, 15, 4, 32
#: Terms kept as full rows, queries multiplied with them at once, and the slack of bounds.
FREQUENT, TOGETHER, NEAR = 128, 64, 1e-9
STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_"
CACHE = 200_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def calibrates(doc_id: int) -> bool:
    """Whether an example belongs to the calibration fold."""
    return zlib.crc32(f"fold {doc_id}".encode()) % FOLDS == 0


def text_terms(text: str | None) -> Counter:
    """Words of a whole text, lower-case and without outer punctuation, with their counts."""
    found: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        word = word.strip(STRIP)
        if word:
            found[word] += n
    return found


def log_likelihood_ratio(a: np.ndarray, n1: int, b: np.ndarray, n0: int) -> np.ndarray:
    """G of terms in a of n1 toxic and b of n0 other examples: 0 where the rates are equal or a side has no example."""
    if not n1 or not n0:
        return np.zeros(len(a))

    def plogp(k: np.ndarray | int) -> np.ndarray:
        k = np.asarray(k, float)
        return k * np.log(np.where(k > 0, k, 1.0))

    def gain(k: np.ndarray, n: int) -> np.ndarray:
        return plogp(k) + plogp(n - k) - plogp(n)

    return np.maximum(2.0 * (gain(a, n1) + gain(b, n0) - gain(a + b, n1 + n0)), 0.0)


def alike(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> np.ndarray:
    """An order in which every ``LANE`` vectors in a row are alike."""
    n = len(vectors)
    owner = np.repeat(np.arange(n), [len(i) for i, _ in vectors])
    ids, weight = (np.concatenate([v[k] for v in vectors]) for k in (0, 1))
    random = np.random.default_rng(5)
    sketch = np.stack([np.bincount(owner, weight * random.choice([-1.0, 1.0], terms)[ids], n) for _ in range(AXES)], axis=1)
    out, open_ = [], [np.arange(n)]
    while open_:
        here = open_.pop()
        if len(here) <= LANE:
            out.append(here)
            continue
        centred = sketch[here] - sketch[here].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        here = here[np.argsort((centred @ axis).round(9), kind="stable")]
        half = max(1, round(len(here) / 2 / LANE)) * LANE
        open_ += [here[half:], here[:half]]
    return np.concatenate(out)


class Index:
    """Weighted terms, examples as sparse vectors, and the block-max inverted index over them.

    ``words``: all words of the examples. ``examples`` and ``fold``: (doc_id, toxic, word numbers, counts) of the index and
    of the calibration fold."""

    def __init__(self, words: list[str], examples: list[tuple], fold: list[tuple]):
        df, toxic_df = np.zeros(len(words)), np.zeros(len(words))
        for _, toxic, ids, _ in examples:
            df[ids] += 1
            if toxic:
                toxic_df[ids] += 1
        kept = sorted(np.flatnonzero(df >= LEAST_DF).tolist(), key=words.__getitem__)
        self.terms = {words[k]: i for i, k in enumerate(kept)}
        number = np.full(len(words), -1, np.int64)
        number[kept] = np.arange(len(kept))
        every, hits = df[kept], toxic_df[kept]
        n1 = sum(e[1] for e in examples)
        n0 = len(examples) - n1
        gain = log_likelihood_ratio(hits, n1, every - hits, n0)
        self.scale = (np.log((1 + n0 + n1) / (1 + every)) + 1.0) * (np.sqrt(gain) + FLOOR)
        both = [e[1] for e in [*examples, *fold]]
        self.bare = min((sum(both) + 0.5) / (len(both) + 10.0), 0.4)

        def vector(e: tuple) -> tuple[np.ndarray, np.ndarray] | None:
            ids = number[e[2]]
            return self._weighted(ids[ids >= 0], e[3][ids >= 0])

        rows = [(vector(e), e[0], e[1]) for e in sorted(examples, key=lambda e: e[:2])]
        rows = [r for r in rows if r[0] is not None]
        if rows:
            rows = [rows[i] for i in alike([r[0] for r in rows], len(kept))]
        self._postings([r[0] for r in rows])
        self.ids, self.toxic = np.array([d for _, d, _ in rows], np.int64), np.array([y for _, _, y in rows], float)
        self.votes, self.rates = np.zeros(1), np.array([self.bare])
        self._calibrate([(vector(e), e[1]) for e in sorted(fold, key=lambda e: e[:2])])

    def _postings(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        none = [np.zeros(0, np.int64)]
        term = np.concatenate([v[0] for v in vectors] or none)
        weight = np.concatenate([v[1] for v in vectors] or none).astype(float)
        example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]).astype(np.int64)
        self.blocks = -(-len(vectors) // LANE)
        # The lists of the most frequent terms hold nearly all examples: they are kept as rows of a full matrix.
        df = np.bincount(term, minlength=len(self.terms))
        frequent = np.sort(np.lexsort((np.arange(len(df)), -df))[:FREQUENT])
        self.column = np.full(len(self.terms), -1, np.int64)
        self.column[frequent] = np.arange(len(frequent))
        full = self.column[term] >= 0
        self.matrix = np.zeros((len(frequent), self.blocks * LANE))
        self.matrix[self.column[term[full]], example[full]] = weight[full]
        term, weight, example = term[~full], weight[~full], example[~full]
        order = np.lexsort((example, term))
        term, example, self.weight = term[order], example[order], weight[order]
        self.lane = (example % LANE).astype(np.int32)  # place in its block
        # For each (term, block): where its postings start and end, and their largest weight.
        pair = term * (1 << 32) + example // LANE
        pair, self.pair_at = np.unique(pair, return_index=True)
        self.pair_max = np.maximum.reduceat(self.weight, self.pair_at) if len(pair) else np.zeros(0)
        self.pair_end = np.append(self.pair_at[1:], len(term))
        self.pair_block = (pair & ((1 << 32) - 1)).astype(np.int64)
        self.lane_at = np.searchsorted(pair, np.arange(len(self.terms) + 1) * (1 << 32))

    def _weighted(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Term numbers, rising, and weights; None without any term."""
        if not len(ids):
            return None
        order = np.argsort(ids)
        ids = ids[order]
        weight = (1.0 + np.log(n[order])) * self.scale[ids]
        return ids, weight / math.sqrt(float(weight @ weight))

    def query(self, text: str | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray] | None:
        """The vector of a text; ``cache`` keeps the terms of words as they are written."""
        found: dict[int, int] = {}
        if len(cache) > CACHE:
            cache.clear()
        terms = self.terms
        for word in (text or "").lower().split():
            i = cache.get(word)
            if i is None:
                i = cache[word] = terms.get(word.strip(STRIP), -1)
            if i >= 0:
                found[i] = found.get(i, 0) + 1
        return self._weighted(np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)))

    def nearest(self, queries: list, k: int = NEIGHBOURS, apart: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query, numbers and cosines of the k nearest examples, cosine above 0, exact, and how many blocks were
        visited. ``apart``: without examples of an equal vector."""
        for a in range(0, len(queries), TOGETHER):
            some = queries[a : a + TOGETHER]
            asked = np.zeros((len(some), len(self.matrix)))
            for i, (ids, weight) in enumerate(some):
                full = self.column[ids] >= 0
                asked[i, self.column[ids[full]]] = weight[full]
            for query, sums in zip(some, asked @ self.matrix, strict=True):
                yield self._nearest(query, sums.reshape(self.blocks, LANE), k, apart)

    def _nearest(self, query: tuple[np.ndarray, np.ndarray], sums: np.ndarray, k: int, apart: bool) -> tuple[np.ndarray, np.ndarray, int]:
        first, end = self.lane_at[query[0]], self.lane_at[query[0] + 1]
        pairs, weight = _runs(first, end), np.repeat(query[1], end - first)
        block = self.pair_block[pairs]
        bound = np.bincount(block, weight * self.pair_max[pairs], self.blocks) + sums.max(1)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        slot = np.empty(self.blocks, np.int64)
        a, step = 0, FIRST_BLOCKS
        while a < len(order) and not (len(best) == k and bound[order[a]] < scores[-1] - NEAR):
            group = order[a : a + step]
            slot[:] = -1
            slot[group] = np.arange(0, len(group) * LANE, LANE)
            base = slot[block]
            here = np.flatnonzero(base >= 0)
            first, end = self.pair_at[pairs[here]], self.pair_end[pairs[here]]
            at, n = _runs(first, end), end - first
            place = np.repeat(base[here], n) + self.lane[at]
            cosine = np.bincount(place, np.repeat(weight[here], n) * self.weight[at], len(group) * LANE)
            # Rounded, so that equal vectors tie wherever they stand.
            cosine = np.round(cosine + sums[group].ravel(), 10)
            if apart:
                cosine[cosine > 1 - 1e-9] = 0
            least = scores[-1] if len(best) == k else 0.0
            hit = np.flatnonzero(cosine >= least) if least else np.flatnonzero(cosine)
            best = np.concatenate([best, group[hit // LANE] * LANE + hit % LANE])
            scores = np.concatenate([scores, cosine[hit]])
            keep = np.lexsort((best, -scores))[:k]
            best, scores, a = best[keep], scores[keep], a + len(group)
            # The few best blocks first, then four times as many, then all that can still hold one of the k nearest.
            step = 4 * step if step < 4 * FIRST_BLOCKS else len(order)
            if len(best) == k:
                order = order[: max(a, int((bound[order] >= scores[-1] - NEAR).sum()))]
        return best, scores, a

    def vote(self, best: np.ndarray, scores: np.ndarray) -> float:
        power = scores * scores
        return float((power * self.toxic[best]).sum() / power.sum()) if len(best) else 0.0

    def _calibrate(self, fold: list[tuple[tuple[np.ndarray, np.ndarray] | None, int]]) -> None:
        fold = [(v, y) for v, y in fold if v is not None]
        if not fold or not len(self.ids):
            return
        near = self.nearest([v for v, _ in fold], apart=True)
        found = sorted((self.vote(best, scores), y) for (best, scores, _), (_, y) in zip(near, fold, strict=True))
        pools: list[list[float]] = []  # sum of votes, toxic, number
        last = None
        for v, y in found:
            if v == last:
                pools[-1] = [pools[-1][0] + v, pools[-1][1] + y, pools[-1][2] + 1.0]
            else:
                pools.append([v, float(y), 1.0])
            last = v
        merged: list[list[float]] = []
        for pool in pools:
            merged.append(pool)
            while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
                top = merged.pop()
                merged[-1] = [x + y for x, y in zip(merged[-1], top, strict=True)]
        self.votes = np.array([p[0] / p[2] for p in merged])
        # One example more, of the mean rate, in each pool keeps scores off 0 and 1.
        self.rates = np.maximum.accumulate(np.array([(p[1] + self.bare) / (p[2] + 1.0) for p in merged]))

    def score(self, texts: list[str | None], cache: dict[str, int]) -> list[tuple[float, list[int]]]:
        """Score and evidence of each text."""
        out: list[tuple[float, list[int]]] = [(self.bare, [])] * len(texts)
        if not len(self.ids):
            return out
        asked = [(i, query) for i, t in enumerate(texts) if (query := self.query(t, cache)) is not None]
        for (i, _), (best, scores, _) in zip(asked, self.nearest([q for _, q in asked]), strict=True):
            if len(best):
                out[i] = float(np.interp(self.vote(best, scores), self.votes, self.rates)), self.ids[best[:5]].tolist()
        return out


def _runs(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers first[i] to end[i] - 1 of all i, one after another."""
    n = end - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = [text_terms(t) for t in batch.column("text").to_pylist()]
        columns = [
            batch.column("id"),
            batch.column("toxic"),
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([list(x) for x in found], pa.list_(pa.string())),
            pa.array([list(x.values()) for x in found], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "toxic", "size", "terms", "counts"])


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, postings: int = POSTINGS) -> Index:
    """The index of labelled examples; ``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.where("toxic is not null and doc_id is not null")
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(examples)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # At most ``examples`` rows of two numbers are broadcast.
    rows = rows.join(F.broadcast(marked), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    counted = rows.mapInArrow(_counted, "id long, toxic int, size long, terms array<string>, counts array<long>")
    counted = scratch.keep(counted.withColumn("at", F.xxhash64("id")), "examples")
    sizes = counted.select("at", "id", "size").orderBy("at", "id").collect()  # ``examples`` rows at most
    total, last = 0, None
    for r in sizes:
        total += r.size
        if total > postings:
            break
        last = r
    if last is None:
        return Index([], [], [])
    within = counted.where((F.col("at") < last.at) | ((F.col("at") == last.at) & (F.col("id") <= last.id)))
    table = within.select("id", "toxic", "terms", "counts").toArrow().combine_chunks()  # ``postings`` terms at most
    words = pc.list_flatten(table.column("terms")).combine_chunks().dictionary_encode()
    code, times = words.indices.to_numpy(), pc.list_flatten(table.column("counts")).to_numpy()
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column("terms")).to_numpy())])
    found = zip(table.column("id").to_pylist(), table.column("toxic").to_pylist(), cuts[:-1], cuts[1:], strict=True)
    held = [(i, y, code[a:b], times[a:b]) for i, y, a, b in found]
    return Index(words.dictionary.to_pylist(), [e for e in held if not calibrates(e[0])], [e for e in held if calibrates(e[0])])


def score_documents(docs: DataFrame, index: Index) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, held_out, score, predicted, evidence), one row each."""
    model = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES and POSTINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in small_batches(batches):
            found = model.value.score(batch.column("text").to_pylist(), cache)
            columns = [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array([x for x, _ in found], pa.float64()),
                pa.array([int(x >= 0.5) for x, _ in found], pa.int32()),
                pa.array([x for _, x in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def keep_clean(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in small_batches(batches, text):
            stay = [x < 0.5 for x, _ in model.value.score(batch.column(text).to_pylist(), cache)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
