"""Removal of repeated passages: every byte of a ``LENGTH``-byte string that also starts in a document of smaller doc_id.

Texts are UTF-8 bytes; strings never cross documents and are judged on the input. Three steps, none of which compares
document with document:

1. Routing. Each ``LENGTH``-byte window is named by the least hash among its ``GRAM``-byte strings (its anchor). A run of
   windows with one anchor is a stretch of at most 80 bytes; equal windows have equal anchors, so only stretches of one
   anchor can share a window. Chunks of documents send their different anchors, and learn which ones another document
   has too. All other stretches are left out: none of their windows can occur twice.
2. Every different stretch of a shared anchor goes, as bytes and once for each chunk, to the index of its anchor's bucket.
   Hashes only choose what is compared: stretches are one class if their bytes are equal. The places of a class stay with
   the chunk, so a passage of half of all documents is no burden for its bucket.
3. Index. The classes of a bucket, each with an end mark of its own, are sorted into a Burrows-Wheeler transform and
   run-length compressed. Match lengths with the row above are measured at the sampled heads of runs only; inside a run
   the preceding byte repeats, so the length at the next text position is one less, and matching statistics are streamed
   along the text from the samples. Rows that match for ``LENGTH`` bytes or more form intervals. The smallest document of
   a position's interval goes back to the chunks and decides, for every place of the class, whether its window is
   removed: no span comes from anywhere else.

An anchor with more than ``HOT`` stretches (a very frequent line in ever other surroundings) is split: its windows reach
13 bytes to the left or 13 bytes to the right of it, so they are dealt by the anchor with these bytes instead.

Texts are written once, bucketed by chunk, and read where they lie in every later step. A chunk sends a row for each
bucket of anchors that it has, so rows never outnumber its stretches.

Defined results: a null text is empty; a text under ``LENGTH`` bytes loses nothing; a null doc_id counts as larger than
all others; rows with the same doc_id take nothing from each other; an empty table gives an empty result; extra columns
are ignored, and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, start_of_task
from ._words import _BYTES, _powers, mix

LENGTH, GRAM, HOT, SIDE = 50, 20, 20_000, 13
PLACES = LENGTH - GRAM + 1
CHUNK, BUCKET = 4 << 20, 16 << 20  # bytes of text for each chunk and for each bucket of anchors
FINER = 2  # the index has 2**FINER times as many buckets
PIECE, INDEX = 1 << 17, 1 << 20  # bytes hashed, and bytes indexed, at a time
LAST = (1 << 63) - 1
_STEPS = [np.uint64(x) for x in np.random.default_rng(11).integers(1, 1 << 62, 6) * 2 + 1]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte planes apart."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        out.append(np.array([len(a)], np.int64).tobytes() + a.dtype.str.ljust(4).encode())
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 12].decode().strip())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 12 + n * kind.itemsize
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together in pieces of about ``PIECE`` bytes: bytes, starts of parts, their text's number, their place in
    it. A long text is cut into parts that share LENGTH - 1 bytes, so that each window is in one part."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[a : a + PIECE + LENGTH - 1]
            held.append((k, a, part))
            size += len(part)
            if size >= PIECE:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, _, p in held])
    return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), np.array([k for k, _, _ in held]), np.array(
        [a for _, a, _ in held]
    )


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first window, last window, place of the anchor, anchor hash, hash of
    the stretch. Least hashes are small numbers: they are hashed again, so that leading bits deal anchors evenly."""
    out = []
    for data, bounds, number, base in _pieces(texts):
        n = len(data)
        h1 = _BYTES[data]
        h2 = h1[:-1] * _STEPS[0] + h1[1:]
        h4 = h2[:-2] * _STEPS[1] + h2[2:]
        h8 = h4[:-4] * _STEPS[2] + h4[4:]
        h16 = h8[:-8] * _STEPS[3] + h8[8:]
        gram = mix(h16[: n - GRAM + 1] * _STEPS[4] + h4[16:])
        low = np.uint64((1 << 22) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)  # the leftmost of equal hashes
        for w in (1, 2, 4, 8):
            least = np.minimum(least[:-w], least[w:])
        least = np.minimum(least[: n - LENGTH + 1], least[PLACES - 16 :])
        anchor = (least & low).astype(np.int64)
        ok = np.ones(n - LENGTH + 1, bool)
        for e in bounds[1:-1]:
            ok[max(0, e - LENGTH + 1) : e] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        anchor = anchor[at]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        first, last, place = at[new], at[np.concatenate([new[1:], [True]])], anchor[new]
        up, down = _powers(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h1 * up[:n])])
        end = last + LENGTH
        whole = mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * _STEPS[5] + (place - first).astype(np.uint64))
        part = np.searchsorted(bounds, first, "right") - 1
        shift = base[part] - bounds[part]
        out.append((number[part], first + shift, last + shift, place + shift, mix(gram[place]), whole))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Documents of a chunk in an order that is the same in every step: ids (null: LAST), texts, rows of the table."""
    ids = table.column("doc_id").fill_null(LAST).to_numpy()
    texts = [
        x.as_buffer().to_pybytes() if x.is_valid else b"" for x in table.column("text").cast(pa.binary()).combine_chunks()
    ] if table.num_rows else []
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], np.array(order, np.int64)


def _runs(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers first[i] to end[i] - 1 of all i, one after another."""
    n = end - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _equal(flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether flat[a : a + size] and flat[b : b + size] agree, for each row; sizes are above 0."""
    out, sums, i = np.ones(len(a), bool), np.cumsum(size), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + PIECE, "right")))
        left, right = _runs(a[i:j], a[i:j] + size[i:j]), _runs(b[i:j], b[i:j] + size[i:j])
        starts = np.concatenate([[0], np.cumsum(size[i:j])[:-1]])
        out[i:j] = np.logical_and.reduceat(flat[left] == flat[right], starts)
        i = j
    return out


def _same(flat: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each stretch and the first stretch of each class. One class: one key and equal bytes."""
    order = np.lexsort((whole, key))
    k, w, n = key[order], whole[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1]) | (n[1:] != n[:-1])
    number, head = np.cumsum(new) - 1, order[new]
    rest = np.flatnonzero(~new)
    bad = rest[~_equal(flat, start[order[rest]], start[head[number[rest]]], n[rest])]
    number[bad] = len(head) + np.arange(len(bad))  # equal hashes of different bytes: classes of their own
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out, np.concatenate([head, order[bad]])


def _cuts(anchor: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted anchors."""
    bucket = (anchor >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchor), np.int64)
    return np.searchsorted(bucket, np.arange((1 << bits) + 1))


def _send(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """The different anchors of a chunk, with their stretches' number of forms and whether two documents have them."""
        start_of_task()
        chunk = table.column("chunk")[0].as_py()
        ids, texts, _ = _ordered(table)
        number, _, _, _, anchor, whole = stretches(texts)
        order = np.lexsort((whole, anchor))
        a, w, d = anchor[order], whole[order], ids[number[order]]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        form = new.copy()
        form[1:] |= w[1:] != w[:-1]
        rows, first = [], np.flatnonzero(new)
        if len(first):
            names, forms = a[first], np.add.reduceat(form.astype(np.int64), first)
            two = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            cuts = _cuts(names, bits)
            for b in np.flatnonzero(np.diff(cuts)):
                here = slice(cuts[b], cuts[b + 1])
                rows.append(
                    (int(b), chunk, pack(np.diff(names[here], prepend=np.uint64(0)), forms[here].astype(np.int32), two[here].astype(np.uint8)))
                )
        return pa.table(
            [pa.array([r[k] for r in rows], (pa.int64(), pa.int64(), pa.binary())[k]) for k in range(3)], names=["bucket", "chunk", "data"]
        )

    return run


def _judge(table: pa.Table) -> pa.Table:
    """For each chunk's anchors of a bucket: 0 no other document has it, 1 one has, 2 the same of a hot anchor."""
    start_of_task()
    bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
    parts = [unpack(x.as_py()) for x in table.column("data")]
    anchor = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    forms, two = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(new)
    chunks_of = np.diff(np.append(first, len(a)))
    shared = (chunks_of > 1) | (np.maximum.reduceat(two[order], first) > 0)
    hot = np.add.reduceat(forms[order].astype(np.int64), first) > HOT
    code = np.empty(len(a), np.uint8)
    code[order] = np.repeat(shared * (1 + hot), chunks_of)
    cuts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    data = [pack(code[cuts[i] : cuts[i + 1]]) for i in range(len(chunks))]
    return pa.table(
        [pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int64()), pa.array(data, pa.binary())], names=["chunk", "bucket", "codes"]
    )


def _side(text: bytes, at: int) -> int:
    return int.from_bytes(hashlib.blake2b(text[at : at + SIDE], digest_size=8).digest(), "little")


def _mark(bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The stretches of a chunk whose anchor is shared, each different one once: for the index of a bucket (key >= 0),
        and their places, for the chunk itself (key < 0)."""
        start_of_task()
        kinds = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
        if not table.num_rows or not answers.num_rows:
            return kinds.empty_table()
        chunk = table.column("chunk")[0].as_py()
        ids, texts, _ = _ordered(table)
        number, first, last, place, anchor, whole = stretches(texts)
        names = np.sort(anchor)
        names = names[np.concatenate([[True], names[1:] != names[:-1]])] if len(names) else names
        code, cuts = np.zeros(len(names), np.uint8), _cuts(names, bits)
        for b, data in zip(answers.column("bucket").to_pylist(), answers.column("codes"), strict=True):
            code[cuts[b] : cuts[b + 1]] = unpack(data.as_py())[0]
        own = code[np.searchsorted(names, anchor)]
        held = np.flatnonzero(own)
        if not len(held):
            return kinds.empty_table()
        number, first, last, place, anchor, whole, own = (x[held] for x in (number, first, last, place, anchor, whole, own))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[number] + first
        of, head = _same(flat, at, last - first + LENGTH, anchor, whole)
        order = np.argsort(of, kind="stable")  # places by class
        count = np.bincount(of, minlength=len(head))
        low, high = (f.reduceat(ids[number[order]], np.cumsum(count) - count) for f in (np.minimum, np.maximum))
        rows = [(-1 - chunk, chunk, pack(count.astype(np.int32), number[order].astype(np.int32), first[order]))]
        key, lo, hi, hot, cls = anchor[head], first[head], last[head], own[head] == 2, np.arange(len(head))
        if hot.any():
            mid = place[head] - SIDE
            left, right = np.flatnonzero(hot & (lo <= mid)), np.flatnonzero(hot & (hi > mid))

            def salt(some: np.ndarray, shift: int) -> np.ndarray:
                return np.array([_side(texts[number[head[i]]], int(mid[i]) + shift) for i in some], np.uint64)

            cold = np.flatnonzero(~hot)
            key = np.concatenate([key[cold], mix(key[left] + salt(left, 0)), mix(key[right] + salt(right, SIDE + GRAM) + np.uint64(1))])
            lo = np.concatenate([lo[cold], lo[left], np.maximum(lo[right], mid[right] + 1)])
            hi = np.concatenate([hi[cold], np.minimum(hi[left], mid[left]), hi[right]])
            cls = np.concatenate([cold, left, right])
        order = np.argsort(key)
        cuts = _cuts(key[order], bits + FINER)
        for b in np.flatnonzero(np.diff(cuts)):
            here = order[cuts[b] : cuts[b + 1]]
            c, size = cls[here], hi[here] - lo[here] + LENGTH
            shift = lo[here] - first[head[c]]
            begin = at[head[c]] + shift
            text = flat[_runs(begin, begin + size)]
            rows.append(
                (
                    int(b), chunk,
                    pack(key[here], whole[head[c]], size.astype(np.int32), low[c], high[c], c.astype(np.int32), shift.astype(np.int32), text)
                )
            )
        return pa.table([pa.array([r[k] for r in rows], kinds.field(k).type) for k in range(3)], schema=kinds)

    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some stretches, with matching statistics from sampled run heads."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """text: the stretches one after another; each gets an end mark that occurs once."""
        n, marks = len(starts), 5
        total = int(sizes.sum()) + marks * n
        at = starts - starts[0] + marks * np.arange(n) if n else starts  # starts in the marked text
        self.starts, self.sizes = at, sizes
        self.text = np.empty(total, np.uint8)
        inside = np.ones(total, bool)
        for k in range(marks):
            where = at + sizes + k
            inside[where] = False
            self.text[where] = 0xFF if k == 0 else 0x80 + ((np.arange(n) >> (7 * (k - 1))) & 0x7F)
        self.text[inside] = text
        self._sort()
        before = self.text[self.rows - 1]
        self.heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))  # first rows of runs
        self.runs = before[self.heads]  # with heads: the run-length transform
        self._stream()

    def _sort(self) -> None:
        """Prefix doubling. The rank of a suffix is the first row of those that agree so far; only rows that share a rank
        are sorted again."""
        n = len(self.text)
        wide = np.zeros(n + 128, np.uint64)
        wide[:n] = self.text
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | wide[k : n + k]
        self.rows = np.argsort(key)
        key = key[self.rows]
        rank = np.empty(n, np.uint32)
        slots, self.levels, width = np.arange(n), [], 8
        while True:
            # ``key``: what decides the order of the rows in ``slots``, in order.
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            rank[self.rows[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            self.levels.append((width, rank.copy()))
            alone = new & np.append(new[1:], True)
            slots = slots[~alone]
            if width >= 128 or not len(slots):
                return  # stretches and end marks are shorter than the last width
            at = self.rows[slots]
            far = at + width
            key = (rank[at].astype(np.uint64) << np.uint64(32)) | np.where(
                far < n, rank[np.minimum(far, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0)
            )
            order = np.argsort(key)
            self.rows[slots], key = at[order], key[order]
            width *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, from the ranks of prefixes of 64, 32, 16 and 8 bytes and by byte."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels[:-1]):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((rank[x] == rank[y]) & (a + out < n) & (b + out < n), width, 0)
        for _ in range(8):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (self.text[x] == self.text[y]) & (a + out < n) & (b + out < n) & (out < 128)
        return out

    def _stream(self) -> None:
        """Match length of each position with the row above its own: measured at run heads and at starts of stretches,
        else one less than at the position before."""
        n = len(self.text)
        row = np.empty(n, np.int64)
        row[self.rows] = np.arange(n)
        sampled = np.zeros(n, bool)
        sampled[self.rows[self.heads]] = True
        sampled[self.starts] = True
        sampled[0] = True
        at = np.flatnonzero(sampled)
        above = self.rows[np.maximum(row[at] - 1, 0)]
        length = np.where(row[at] > 0, self._common(at, above), 0)
        from_ = np.maximum.accumulate(np.where(sampled, np.arange(n), 0))
        value = np.zeros(n, np.int64)
        value[at] = length
        self.match = value[from_] - (np.arange(n) - from_)

    def smallest(self, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """For each position, the least owner (a number for each stretch) of a position whose next ``length`` bytes agree."""
        by_stretch = np.repeat(owner, self.sizes + 5)
        new = self.match[self.rows] < length
        new[0] = True
        least = np.minimum.reduceat(by_stretch[self.rows], np.flatnonzero(new))
        out = np.empty(len(self.rows), by_stretch.dtype)
        out[self.rows] = least[np.cumsum(new) - 1]
        return out


def least_holders(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (stretch, first window, last window, least id) of the stretches' windows: the least id of a stretch that has
    the same ``LENGTH`` bytes, from the index over all of them."""
    sizes = sizes.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    index = RunLengthIndex(text, starts, sizes)
    least = index.smallest(ids)
    at = _runs(index.starts, index.starts + sizes - LENGTH + 1)
    stretch = np.repeat(np.arange(len(sizes)), sizes - LENGTH + 1)
    least, place = least[at], at - index.starts[stretch]
    new = np.ones(len(at), bool)
    new[1:] = (stretch[1:] != stretch[:-1]) | (least[1:] != least[:-1])
    end = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    return stretch[new], place[new], place[end], least[new]


ANSWERS = pa.schema([("chunk", pa.int64()), ("places", pa.bool_()), ("data", pa.binary())])


def _index(table: pa.Table) -> pa.Table:
    """For each chunk, from the stretches of one bucket: (class, first byte, end, least document) of the runs of windows
    that a smaller document may have. A chunk's places pass through."""
    start_of_task()
    if table.column("key")[0].as_py() < 0:
        return pa.table([table.column("chunk"), pa.array([True] * table.num_rows), table.column("data")], schema=ANSWERS)
    parts = [unpack(x.as_py()) for x in table.column("data")]
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(p[0]) for p in parts])
    key, whole, size, low, high, number, shift, text = (np.concatenate([p[k] for p in parts]) for k in range(8))
    del parts
    size = size.astype(np.int64)
    start = np.cumsum(size) - size
    cls, head = _same(text, start, size, key, whole)
    owner = np.full(len(head), LAST)
    np.minimum.at(owner, cls, low)
    order = np.argsort(key[head], kind="stable")
    keys, sums, a, found = key[head[order]], np.cumsum(size[head[order]]), 0, []
    while a < len(order):  # whole keys, about INDEX bytes at a time
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + INDEX, "right")))
        b = int(np.searchsorted(keys, keys[b - 1], "right"))
        here = order[a:b]
        body = text[_runs(start[head[here]], start[head[here]] + size[head[here]])]
        s, lo, hi, least = least_holders(body, size[head[here]], owner[here])
        found.append((here[s], lo, hi + LENGTH, least))
        a = b
    run_cls, lo, hi, least = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(run_cls, kind="stable")
    run_cls, lo, hi, least = run_cls[order], lo[order], hi[order], least[order]
    from_ = np.searchsorted(run_cls, np.arange(len(head) + 1))
    # Every run of its class concerns a chunk's stretch if the least document comes before the chunk's last one with it.
    run = _runs(from_[cls], from_[cls + 1])
    row = np.repeat(np.arange(len(cls)), from_[cls + 1] - from_[cls])
    gone = least[run] < high[row]
    run, row = run[gone], row[gone]
    order = np.argsort(chunk[row], kind="stable")
    run, row = run[order], row[order]
    names, cuts = np.unique(chunk[row], return_index=True)
    rows = []
    for c, a, b in zip(names, cuts, np.append(cuts, len(row))[1:], strict=True):
        r, k = row[a:b], run[a:b]
        rows.append((int(c), False, pack(number[r], lo[k] + shift[r], hi[k] + shift[r], least[k])))
    return pa.table([pa.array([r[k] for r in rows], ANSWERS.field(k).type) for k in range(3)], schema=ANSWERS)


def _spans(answers: pa.Table, ids: np.ndarray) -> list[list[tuple[int, int]]]:
    """Maximal removed runs of each of the chunk's documents."""
    out: list[list[tuple[int, int]]] = [[] for _ in ids]
    held = dict.fromkeys((True, False), ())
    for kind in held:
        held[kind] = [unpack(x.as_py()) for x in answers.filter(pc.equal(answers.column("places"), kind)).column("data")]
    if not held[True] or not held[False]:
        return out
    count, number, first = held[True][0]
    from_ = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
    cls, lo, hi, least = (np.concatenate([p[k] for p in held[False]]) for k in range(4))
    at = _runs(from_[cls], from_[cls + 1])
    of = np.repeat(np.arange(len(cls)), count[cls])
    gone = ids[number[at]] > least[of]
    at, of = at[gone], of[gone]
    number, lo, hi = number[at], first[at] + lo[of], first[at] + hi[of]
    order = np.lexsort((lo, number))
    number, lo, hi = number[order], lo[order], hi[order]
    # Runs that touch are one: ends so far within a document, found in one line by giving each document a range of its own.
    line = number.astype(np.int64) * (int(hi.max()) + 2 if len(hi) else 0)
    end = np.maximum.accumulate(line + hi) if len(hi) else hi
    new = np.ones(len(lo), bool)
    new[1:] = (line + lo)[1:] > end[:-1]
    starts = np.flatnonzero(new)
    for i, a, b in zip(
        number[starts].tolist(), lo[starts].tolist(), (end - line)[np.append(starts[1:] - 1, len(lo) - 1)[: len(starts)]].tolist(), strict=True
    ):
        out[i].append((a, b))
    return out


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _removed_spans(texts: DataFrame, size: int) -> DataFrame:
    """(chunk, places, data): what ``_spans`` needs, from the bucketed table of texts (chunk, doc_id, text)."""
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / BUCKET)))))
    sent = texts.groupBy("chunk").applyInArrow(_send(bits), "bucket long, chunk long, data binary")
    answers = sent.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_judge, "chunk long, bucket long, codes binary")
    shared = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_mark(bits), "key long, chunk long, data binary")
    return shared.repartition(1 << (bits + FINER), "key").groupBy("key").applyInArrow(_index, "chunk long, places boolean, data binary")


def _chunked(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The documents with a chunk, written in buckets of chunks, and their bytes."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK))
    # The place of a row salts the hash: repeated rows are dealt over all chunks.
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk")
    return scratch.keep_bucketed(docs.select(chunk, "*"), "texts", "chunk", chunks), size


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row each."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts, size = _chunked(rows, scratch)

    def finish(table: pa.Table, spans: pa.Table) -> pa.Table:
        start_of_task()
        ids, texts, order = _ordered(table)
        found = _spans(spans, ids)
        removed = [sum(b - a for a, b in s) for s in found]
        digest = [hashlib.sha256(_rest(t, s) if s else t).hexdigest() for t, s in zip(texts, found, strict=True)]
        pairs = pa.array([[{"start": a, "end": b} for a, b in s] for s in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table(
            [
                table.column("doc_id").take(pa.array(order)).combine_chunks(), pa.array([len(t) for t in texts], pa.int64()),
                pa.array(removed, pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array(digest, pa.string()), pairs
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        )

    spans = _removed_spans(texts, size)
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any columns) without their repeated bytes; a character that loses a byte is
    dropped whole. Rows whose text is gone entirely are dropped; a row with nothing to remove is as it was."""
    scratch = Scratch(docs.sparkSession, "suffix-keep")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at_id, at_text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    plain = docs.toDF(*names)
    rows = plain.select(F.col(at_id).cast("long").alias("doc_id"), F.coalesce(F.col(at_text).cast("string"), F.lit("")).alias("text"), *names)
    texts, size = _chunked(rows, scratch)
    spans = _removed_spans(texts.select("chunk", "doc_id", "text"), size)
    kept = [f for f in plain.schema.fields]

    def finish(table: pa.Table, spans: pa.Table) -> pa.Table:
        start_of_task()
        ids, texts, order = _ordered(table)
        found = _spans(spans, ids)
        new, stay = table.column(at_text).to_pylist(), [True] * len(texts)
        for k, s in enumerate(found):
            if s:
                new[order[k]] = _rest(texts[k], s).decode("utf-8", "ignore")
                stay[order[k]] = bool(new[order[k]])
        table = table.set_column(table.schema.get_field_index(at_text), at_text, pa.array(new, pa.string()))
        return table.select(names).filter(pa.array(stay, pa.bool_()))

    schema = type(plain.schema)(kept)
    return texts.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(finish, schema).toDF(*docs.columns)
