"""Language-model scores by masked pseudo-likelihood.

Every word of a text is predicted from the two words before and the two after it, as if it were masked: a window network
(one embedding table for each of the four places, tanh, softmax factored into classes and members) gives
log P(word | both sides). A document's score is the sum over its words. The network is trained in numpy.

Word ids: the ``WORDS`` most frequent words of the whole corpus (A-Z folded; counted over all documents) have their own,
all others share ``BUCKETS`` ids by hash. The network gives the probability of an id; it is divided among the words of a
shared id by their corpus counts, the document's own occurrences left out: a word that occurs n times in the corpus and k
times in the document has the share (n - k) / (N + 1) of its id, N being the id's count, and a word that no other
document has 1 / ((N + 1) * ``UNSEEN``). These counts grow with the corpus and meet the documents' words by a join.

Scores do not depend on how the input is split, nor on the processor's kernels for matrix products: a trained network is
put on a grid on which sums of products are exact. Training repeats on one kind of processor only; on a cluster of several
kinds, runs differ in the last digits of the weights.

Training covers the corpus and does not depend on how the input is split: texts are dealt, by a hash of their ids and one
further for each copy, into shards of about ``SHARD`` words. A shard trains a copy of one starting network on its texts,
in the order of their hashes; the copies are averaged, weighted by their words, in levels of ``FAN``, block by block of
parameters: no task or driver ever holds more than ``FAN`` blocks. The average is the next round's start. A hash of a
text and a place in it deals all words into rounds: each word of the corpus is the target of exactly one step.

Defined results: null and empty texts have 0 words, score 0 and no mean; a null doc_id stays null; repeated rows get
equal scores; without any word the network stays as it started. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import hashed_words, mix, offsets_and_bytes, small_batches

WORDS, BUCKETS, CLASSES, DIM = 4096, 4096, 64, 24
MEMBERS = (WORDS + BUCKETS) // CLASSES
PLACES = (-2, -1, 1, 2)
BATCH, RATE, ROUNDS, FAN, PARTS = 1024, 0.15, 2, 32, 8
SHARD = 2_000_000
UNSEEN, KNOWN = 16, 1_000_000
#: Logarithms are added as whole numbers of 2**-30, so that a sum does not depend on the order of its terms.
UNIT = float(1 << 30)
#: Steps of one of the scoring network's numbers, and the largest of its weights.
GRID, LIMIT = float(1 << 20), 32.0
PAD = WORDS + BUCKETS


class Network:
    """Parameters as one flat float32 vector with named views; a layer's biases are the last row of its weights, met by a
    hidden value that is always 1."""

    SHAPES = {
        "embed": (len(PLACES) * (PAD + 1), DIM),
        "hidden": (DIM,),
        "first": (DIM + 1, CLASSES),
        "second": (CLASSES, DIM + 1, MEMBERS),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        self._name()
        self.plain = False

    def _name(self) -> None:
        self.classes, self.class_bias = self.first[:DIM], self.first[DIM]
        self.members, self.member_bias = self.second[:, :DIM], self.second[:, DIM]

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> Network:
        """Small random weights; biases from the corpus counts of the ids."""
        net = cls((np.random.default_rng(seed).standard_normal(cls.SIZE) * 0.1).astype(np.float32))
        by = (counts + 1.0).reshape(CLASSES, MEMBERS)
        net.members[:] = net.second.ravel()[: net.members.size].reshape(net.members.shape).copy()
        net.hidden[:] = 0
        net.class_bias[:] = np.log(by.sum(1) / by.sum())
        net.member_bias[:] = np.log(by / by.sum(1, keepdims=True))
        return net

    def on_grid(self) -> Network:
        """The network with its output layers in whole numbers of 1 / ``GRID``, as float64. With hidden values on the grid,
        too, a sum of ``DIM + 1`` products needs 52 bits at most: no order, block or processor rounds it differently."""
        net = Network(self.flat)
        for name in ("first", "second"):
            setattr(net, name, np.clip(np.rint(getattr(self, name).astype(np.float64) * GRID), -LIMIT * GRID, LIMIT * GRID) / GRID)
        net._name()
        # No score of the network is further from zero, as hidden values are within 1.
        net.plain = bool(max(np.abs(net.first).sum(0).max(), np.abs(net.second).sum(1).max()) < PLAIN)
        return net

    @staticmethod
    def rows(context: np.ndarray) -> np.ndarray:
        """The rows of ``embed`` that contexts use, a line for each place."""
        return context.T.astype(np.uint16) + STARTS[:, None]

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Hidden values of contexts, given by their ``rows``."""
        found = self.embed.take(rows.ravel(), axis=0).reshape(len(PLACES), -1, DIM)  # several times faster than by an index
        h = found[0]
        h += self.hidden
        for k in range(1, len(PLACES)):
            h += found[k]
        return np.tanh(h, out=h)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target | context) for each row, of a network ``on_grid``: the same in any block of rows."""
        order = np.argsort(target.astype(np.uint16), kind="stable")
        target = target.take(order).astype(np.int64)
        hidden = self.forward(self.rows(context.take(order, axis=0)))
        cls, member = target // MEMBERS, target % MEMBERS
        h, logs, room = np.ones((len(order), DIM + 1)), np.empty(len(order), np.float32), _Room(self)
        for i in range(0, len(h), PIECE):
            here = slice(i, min(i + PIECE, len(h)))
            h[here, :DIM] = np.rint(np.multiply(hidden[here], GRID, dtype=np.float64)) / GRID
            logs[here] = room.log_shares(h[here], self.first, cls[here])
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for c in range(CLASSES):
            for i in range(cuts[c], cuts[c + 1], PIECE):
                here = slice(i, min(i + PIECE, cuts[c + 1]))
                logs[here] += room.log_shares(h[here], self.second[c], member[here])
        out = np.empty(len(order))
        out[order] = logs
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of stochastic gradient descent on the negative log-probability. A row of a table that n words of the
        batch use moves by their summed gradient over the square root of n.

        Softmax values are never divided by their sums: what meets them in products, which is shorter, is."""
        order = np.argsort(target.astype(np.uint16), kind="stable")
        used, target = self.rows(context.take(order, axis=0)), target.take(order).astype(np.int64)
        n, rows = len(target), np.arange(len(target))
        cls, own = target // MEMBERS, rows * MEMBERS + target % MEMBERS
        hidden = self.forward(used)
        h = np.ones((n + 1, DIM + 1), np.float32)
        h[:n, :DIM] = hidden
        h[n] = 0
        # Classes.
        p = np.empty((n, CLASSES), np.float32)
        part = _less_own(p, rows * CLASSES + cls, lambda: np.matmul(h[:n], self.first, out=p))[:, None]
        back = p @ self.classes.T
        back *= part
        self.first -= (h[:n] * (part * np.float32(rate / np.sqrt(n)))).T @ p
        # Members; rows are sorted by class, ``cuts`` are the classes' first rows. Classes of few rows are multiplied in a tile
        # for each, filled up with the row after the last, which has no hidden values.
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        count = np.diff(cuts)
        few, inside = count <= TILE, np.arange(TILE)
        filled = (inside < count[:, None]) & few[:, None]
        slots = np.where(filled, cuts[:-1, None] + inside, n).ravel()
        more = [(c, cuts[c], cuts[c + 1]) for c in np.flatnonzero(~few).tolist()]
        q, below = np.empty((n + 1, MEMBERS), np.float32), np.empty((n + 1, DIM), np.float32)

        def scores() -> None:
            tiles = h.take(slots, axis=0).reshape(CLASSES, TILE, DIM + 1) @ self.second
            np.put(q.view(LINE).ravel(), slots, tiles.view(LINE).ravel())
            for c, i, j in more:
                np.dot(h[i:j], self.second[c], out=q[i:j])

        part = _less_own(q[:n], own, scores)
        factor = part * (np.float32(rate) / np.sqrt(np.maximum(count, 1)).astype(np.float32)).take(cls)
        shared = np.zeros((n + 1, DIM + 1), np.float32)
        np.multiply(h[:n], factor[:, None], out=shared[:n])
        q[n] = 0
        tiles = q.view(LINE).ravel().take(slots).view(np.float32).reshape(CLASSES, TILE, MEMBERS)
        np.put(below.view(ROW).ravel(), slots, (tiles @ self.members.transpose(0, 2, 1)).view(ROW).ravel())
        for c, i, j in more:
            np.dot(q[i:j], self.members[c].T, out=below[i:j])
        self.second -= shared.take(slots, axis=0).reshape(CLASSES, TILE, DIM + 1).transpose(0, 2, 1) @ tiles
        for c, i, j in more:
            self.second[c] -= np.dot(shared[i:j].T, q[i:j])
        below = below[:n]
        below *= part[:, None]
        back += below
        hidden *= hidden
        np.subtract(1, hidden, out=hidden)
        back *= hidden
        back *= np.float32(rate)
        self.hidden -= back.sum(0) / np.float32(np.sqrt(n))
        # Embeddings: most rows are used once or twice, only the others are summed in runs.
        used = used.ravel()
        order = np.argsort(used, kind="stable")  # by digits
        used, of = used.take(order), order % n
        new = np.ones(len(used) + 1, bool)
        np.not_equal(used[1:], used[:-1], out=new[1:-1])
        ends = np.flatnonzero(new)
        first, times = ends[:-1], np.diff(ends)
        moved = back.take(of.take(first), axis=0)
        twice, often = np.flatnonzero(times == 2), np.flatnonzero(times > 2)
        if len(twice):
            moved[twice] = (moved.take(twice, axis=0) + back.take(of.take(first.take(twice) + 1), axis=0)) * np.float32(2**-0.5)
        if len(often):
            many, start = times.take(often), first.take(often)
            sums = np.add.reduceat(back.take(of.take(_runs(start, start + many)), axis=0), np.cumsum(many) - many)
            sums /= np.sqrt(many).astype(np.float32)[:, None]
            moved[often] = sums
        used = used.take(first).astype(np.int64)
        np.subtract(self.embed.take(used, axis=0), moved, out=moved)
        np.put(self.embed.view(ROW).ravel(), used, moved.view(ROW).ravel())


#: A row of a table of embeddings, or of scores, as one value; the first row of each place's table.
ROW, LINE, STARTS = np.dtype((np.void, 4 * DIM)), np.dtype((np.void, 4 * MEMBERS)), (np.arange(len(PLACES)) * (PAD + 1)).astype(np.uint16)
#: Rows of a tile of a training step, and rows that are scored together: their scores stay in a core's cache.
TILE, PIECE = 20, 256
#: Words that are sorted by class and scored by one call.
TOGETHER = 32768
#: Scores within this are raised to powers as they are, others less the row's largest.
PLAIN = 60.0
ONES = np.ones(max(CLASSES, MEMBERS), np.float32)


class _Room:
    """Arrays for the scores of ``PIECE`` rows."""

    def __init__(self, net: Network):
        self.plain, self.exact, self.x = net.plain, np.empty(PIECE * MEMBERS), np.empty(PIECE * MEMBERS, np.float32)
        self.starts = {k: np.arange(0, PIECE * k, k) for k in (CLASSES, MEMBERS)}

    def log_shares(self, h: np.ndarray, layer: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Logarithms of the softmax at each row's own column. Scores are exact, and rounded once to float32."""
        n, size = len(h), layer.shape[1]
        exact, x = self.exact[: n * size].reshape(n, size), self.x[: n * size].reshape(n, size)
        np.matmul(h, layer, out=exact)
        np.copyto(x, exact, casting="same_kind")
        mine = self.x.take(self.starts[size][:n] + own)
        if not self.plain:
            top = x.max(1)
            x -= top[:, None]
            mine -= top
        np.exp(x, out=x)
        mine -= np.log(np.einsum("ij->i", x))
        return mine


def _less_own(x: np.ndarray, own: np.ndarray, scores: Callable) -> np.ndarray:
    """Fills ``x`` by a call of ``scores`` and turns it into powers of e, less the row's sum at its own place (given in the
    flat array). Returns one over the rows' sums, by which the softmax's gradient is to be multiplied."""
    scores()
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
        sums = x @ ONES[: x.shape[1]]
    if not (sums.min() > 1e-25 and sums.max() < 1e25):  # far scores: less the row's largest
        scores()
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        sums = x @ ONES[: x.shape[1]]
    x.ravel()[own] -= sums
    return np.divide(1, sums, out=sums)


class Vocabulary:
    """Word hashes to ids."""

    def __init__(self, top: list[int]):
        hashes = np.array(top, np.int64).view(np.uint64)
        self.rank = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.rank]

    def ids(self, words: np.ndarray) -> np.ndarray:
        out = (words % np.uint64(BUCKETS)).astype(np.int64) + WORDS
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = self.hashes[at] == words
            out[known] = self.rank[at[known]]
        return out


class Counts:
    """Corpus counts of the most frequent words: at most ``KNOWN``, all that occur at least as often as some number."""

    def __init__(self, counts: DataFrame, most: int):
        least, held = 2, 0
        for r in counts.where("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).toLocalIterator():
            held += r.c
            least = r.n
            if held > most:
                least = r.n + 1
                break
        table = counts.where(F.col("n") >= least).toArrow()  # ``most`` rows of two numbers
        words, n = (table.column(c).to_numpy() for c in ("word", "n"))
        order = np.argsort(words.view(np.uint64))
        self.words, self.n = words.view(np.uint64)[order], n[order]

    def find(self, words: np.ndarray) -> np.ndarray:
        """Counts, 0 for words that are not held."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.n[at], 0)


def _runs(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers first[i] to end[i] - 1 of all i, one after another."""
    n = end - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of ids (binary, two bytes each) in one line, two pads before and after each: the line, the places of all
    words in it, and the number of words of each text."""
    off, data = offsets_and_bytes(column)
    ids = np.frombuffer(data[int(off[0]) : int(off[-1])].tobytes(), np.uint16)
    n = np.diff(off) // 2
    first = np.cumsum(n + 2) - n
    line = np.full(int((n + 2).sum()) + 2, PAD, np.uint16)
    at = _runs(first, first + n)
    line[at] = ids
    return line, at, n


def _context(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ids.take(at[:, None] + np.array(PLACES))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's word hashes."""
    held, size = [], 0
    for batch in small_batches(batches):
        found = [w for _, w in hashed_words(batch.column("text"))]
        held.append(np.unique(np.concatenate(found), return_counts=True))
        size += len(held[-1][0])
        if size > HELD:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield from _emitted(*held[0])
                held, size = [], 0
    if held:
        yield from _emitted(*_merged(held))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, n = (np.concatenate(x) for x in zip(*held, strict=True))
    both, at = np.unique(words, return_inverse=True)
    return both, np.bincount(at, n, len(both)).astype(np.int64)


#: Words that a task holds counts of before it merges them; if half as many are different, it sends them on.
HELD = 2_000_000


def _emitted(held: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(held), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(held[i : i + 50_000].view(np.int64)), pa.array(counts[i : i + 50_000])], ["word", "n"])


def vocabulary(docs: DataFrame, scratch: Scratch) -> tuple[Vocabulary, DataFrame, np.ndarray]:
    """From all documents (text): the vocabulary, counts (word, n) of all words, and the counts of all ids."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = scratch.keep(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    mass = np.zeros(PAD)
    mass[: len(top)] = [r.n for r in top]
    known = spark.createDataFrame([(r.word,) for r in top], "word long")
    # The hash of a word is used unsigned; its residue for a power of two is that of the signed number's low bits.
    rest = counts.join(F.broadcast(known), "word", "left_anti").groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.sum("n").alias("n"))
    for r in rest.collect():  # ``BUCKETS`` rows at most
        mass[WORDS + r.b] = r.n
    return Vocabulary([r.word for r in top]), counts, mass


def tokens(docs: DataFrame, words: Vocabulary, counts: DataFrame) -> DataFrame:
    """Documents (doc_id, text) to (row, doc_id, n, ids, share, words, times): ids as two bytes each, the sum of logarithms
    of the known words' shares, and the other words of shared ids with their numbers of times."""
    held = docs.sparkSession.sparkContext.broadcast((words, Counts(counts, KNOWN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches):
            texts = [found for _, found in hashed_words(batch.column("text"))]
            n = np.array([len(x) for x in texts], np.int64)
            flat = np.concatenate(texts)
            vocabulary, known = held.value
            ids = vocabulary.ids(flat)
            line = ids.astype(np.uint16).tobytes()
            cuts = 2 * np.concatenate([[0], np.cumsum(n)])
            # The different (text, word) of shared ids, in order of texts.
            out = np.flatnonzero(ids >= WORDS)
            owner, word = np.repeat(np.arange(len(n)), n)[out], flat[out]
            order = np.lexsort((word, owner))
            owner, word = owner[order], word[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            owner, word = owner[first], word[first]
            total = known.find(word)
            logs = np.where(total > times, np.log(np.maximum(total - times, 1)), -np.log(UNSEEN))
            share = np.zeros(len(n), np.int64)
            np.add.at(share, owner, np.where(total > 0, times * np.rint(logs * UNIT).astype(np.int64), 0))
            owner, word, times = owner[total == 0], word[total == 0], times[total == 0]
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]), pa.int32())
            columns = [
                pa.array(np.arange(row, row + len(n))),
                batch.column("doc_id"),
                pa.array(n),
                pa.array([line[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                pa.array(share),
                pa.ListArray.from_arrays(lists, pa.array(word.view(np.int64))),
                pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "ids", "share", "words", "times"])
            row += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, ids binary, share long, words array<long>, times array<int>")


def _learn(flat: np.ndarray, shard: pa.Table, turn: int, rounds: int) -> tuple[np.ndarray, int]:
    """The network after a shard's words of a round, and their number. Rows (key, copy, ids) in order of keys."""
    keys = shard.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")  # rows of one key have one text
    line, at, n = padded(shard.column("ids").combine_chunks().take(pa.array(order)))
    place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    dealt = mix(np.repeat(keys[order], n) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(rounds)
    at = at[dealt == turn]
    at = at[np.random.default_rng(turn).permutation(len(at))]
    net = Network(flat.copy())
    steps = -(-len(at) // BATCH)
    for k in range(steps):
        here = at[k * BATCH : (k + 1) * BATCH]
        # The rate falls to a quarter along the rounds.
        net.step(_context(line, here), line[here], RATE * (1 - 0.75 * (turn + k / steps) / rounds))
    return net.flat, len(at)


def _learner(start, turn: int, rounds: int):
    """Trains a shard's copy of the broadcast network; gives it in ``PARTS`` blocks."""
    size = -(-Network.SIZE // PARTS)

    def run(table: pa.Table) -> pa.Table:
        flat, seen = _learn(start.value, table, turn, rounds)
        shard = table.column("shard")[0].as_py()
        columns = [
            pa.array(np.arange(PARTS), pa.int32()),
            pa.array([shard] * PARTS, pa.int64()),
            pa.array([seen] * PARTS, pa.int64()),
            pa.array([flat[k * size : (k + 1) * size].tobytes() for k in range(PARTS)], pa.binary()),
        ]
        return pa.table(columns, names=["part", "shard", "n", "data"])

    return run


def train(rows: DataFrame, mass: np.ndarray, scratch: Scratch, rounds: int = ROUNDS) -> Network:
    """The network, from all tokenised texts (n, ids) and the counts of ids."""
    spark = rows.sparkSession
    net = Network.start(mass)
    # Copies of a text are dealt over the shards, each trains on its own.
    texts = rows.where("n > 0").groupBy("ids").agg(F.count(F.lit(1)).alias("c"))
    texts = texts.select("ids", F.xxhash64("ids").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("copy"))
    shards = max(1, int(-(-mass.sum() // SHARD)))
    dealt = texts.withColumn("shard", F.pmod(F.col("key") + F.col("copy"), F.lit(shards)))
    dealt = scratch.keep_bucketed(dealt, "dealt", "shard", shards)
    if not mass.sum():
        return net
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(net.flat)

        learned = dealt.groupBy("shard").applyInArrow(
            _learner(held, turn, rounds), "part int, shard long, n long, data binary"
        )
        parts = scratch.keep(learned.where("n > 0"), f"round{turn}-0")
        level, most = 0, shards - 1
        while most:
            merged = parts.withColumn("up", F.expr(f"shard div {FAN}")).groupBy("part", "up").applyInArrow(
                _average, "part int, shard long, n long, data binary"
            )
            level, most = level + 1, most // FAN
            parts = scratch.keep(merged, f"round{turn}-{level}")
        blocks = parts.orderBy("part").collect()  # one network
        if blocks:
            net = Network(np.concatenate([np.frombuffer(r.data, np.float32) for r in blocks]).copy())
    scratch.drop("dealt")
    return net


def _average(table: pa.Table) -> pa.Table:
    """The mean of some copies of one block, weighted by words, in the order of shards."""
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("n").to_pylist(), range(table.num_rows), strict=True))
    total, out = sum(n for _, n, _ in rows), None
    for _, n, i in rows:
        piece = np.frombuffer(table.column("data")[i].as_py(), np.float32).astype(np.float64) * (n / total)
        out = piece if out is None else out + piece
    part, up = table.column("part")[0].as_py(), table.column("up")[0].as_py()
    columns = [
        pa.array([part], pa.int32()), pa.array([up], pa.int64()), pa.array([total], pa.int64()),
        pa.array([out.astype(np.float32).tobytes()], pa.binary())
    ]
    return pa.table(columns, names=["part", "shard", "n", "data"])


def score(rows: DataFrame, net: Network, counts: DataFrame, mass: np.ndarray, scratch: Scratch) -> DataFrame:
    """Tokenised documents to (doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability), one row each."""
    held = rows.sparkSession.sparkContext.broadcast((net.flat, np.log(mass + 1.0)))  # a fixed number of parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, whole = held.value
        own, shared = Network(flat).on_grid(), np.where(np.arange(PAD) < WORDS, 0.0, whole)
        for batch in small_batches(batches, "ids", 1 << 20):
            line, at, n = padded(batch.column("ids"))
            logs = np.zeros(len(at) + 1, np.int64)
            for i in range(0, len(at), TOGETHER):
                here = at[i : i + TOGETHER]
                own_ids = line.take(here)
                logs[i + 1 : i + 1 + len(here)] = np.rint((own.log_probability(_context(line, here), own_ids) - shared.take(own_ids)) * UNIT)
            ends = np.cumsum(n)
            logs = np.cumsum(logs)  # whole numbers: a text's sum is a difference
            total = logs[ends] - logs[ends - n]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("n"), pa.array(total + batch.column("share").to_numpy())], ["row", "doc_id", "n", "total"]
            )

    scored = rows.select("row", "doc_id", "n", "ids", "share").mapInArrow(run, "row long, doc_id long, n long, total long")
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("k")
    )
    share = F.when(F.col("n") > F.col("k"), F.log(F.col("n") - F.col("k"))).otherwise(F.lit(-float(np.log(UNSEEN))))
    known = each.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    added = known.groupBy("row").agg(F.sum(F.col("k") * F.round(share * UNIT).cast("long")).alias("log"))
    both = scored.join(added, "row", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), ((F.col("total") + F.coalesce("log", F.lit(0))) / UNIT).alias("pseudo_log_likelihood")
    )
    return both.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")))


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on all documents and scores all of them."""
    scratch = Scratch(docs.sparkSession, "scoring")
    words, counts, mass = vocabulary(docs, scratch)
    rows = scratch.keep(tokens(docs, words, counts), "tokens")
    return score(rows, train(rows, mass, scratch), counts, mass, scratch)
