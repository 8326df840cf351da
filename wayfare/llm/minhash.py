"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct ``SHINGLE``-word shingles (A-Z folded; with fewer words, the whole sequence as one).
Two permutations give all coordinates of a signature: sigma sends a shingle to a slot of 0..SLOTS-1, pi is one fixed
permutation of the slots, and coordinate k is the least pi[(slot + k) mod SLOTS] over the set, pi circularly shifted by
k. ``BANDS`` bands of ``ROWS`` coordinates choose candidates: at similarity 0.75 a pair misses all 32 bands of 4 with
probability 5e-6.

Candidates are confirmed on full sets, without all pairs of a group:

1. documents with equal sets (by a 128-bit digest of the whole sorted set) become one node;
2. in each bucket every node is compared with one node, the smallest of the bucket; links give components;
3. where a bucket still holds several components, nodes of different components are compared too, as far as sizes allow a
   link. In buckets of up to ``SMALL`` nodes, pairs are listed, unless the triangle inequality of the Jaccard distance to
   the bucket's smallest node excludes a link. In larger buckets all nodes are compared with the largest node, too, which
   joins most of a large group of copies. What is left forms clusters, dealt in blocks of ``BLOCK`` nodes; a task
   takes the sets of two blocks through an exact prefix filter (a set's shingles in order, the rarest first: two sets of
   similarity 0.75 share one of the first n - ceil(0.75 n) + 1 of each) and returns only links between components, a
   spanning forest of them. Nodes of one component need no further comparison: the result would be the same.

So after step 3 every pair that shares a bucket is in one component or was excluded exactly.

Defined results: a null or empty text, or one without words, has 0 shingles and is linked with nothing, its own
component, kept. Repeated rows share a set. A null doc_id stays null, its class takes the smallest other doc_id, and it
is kept only if its component has no doc_id at all. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import hashed_words, mix, shingles, small_batches
from .components import components

SHINGLE, SLOTS, BANDS, ROWS, PERCENT = 5, 1 << 20, 32, 4, 75
#: Members of a group that are compared with its first node by one task.
GROUP = 256
SMALL, BLOCK = 16, 512
_state: dict[str, np.ndarray] = {}


def _circulant() -> np.ndarray:
    """Rows of pi at each slot: row s is pi[s], pi[s + 1], ... (circular), one entry for each coordinate."""
    if not _state:
        pi = np.random.default_rng(7).permutation(SLOTS).astype(np.uint32)
        _state["pi"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: BANDS * ROWS]]), BANDS * ROWS)
    return _state["pi"]


def signature(found: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set of shingle hashes."""
    rows = _circulant()
    slots = (mix(found ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(44)).astype(np.int64)
    best = rows[slots[:2048]].min(axis=0)
    for i in range(2048, len(slots), 2048):
        best = np.minimum(best, rows[slots[i : i + 2048]].min(axis=0))
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the number of the band is part of it."""
    at = np.arange(1, BANDS + 1, dtype=np.uint64)
    out = at * np.uint64(0x9E3779B97F4A7C15)
    part = sig.astype(np.uint64).reshape(BANDS, ROWS)
    for j in range(ROWS):
        out = mix(out + part[:, j] * np.uint64(0xD1342543DE82EF95) + np.uint64(j))
    return out


def digest(found: np.ndarray) -> bytes:
    """16 bytes that stand for a whole set (sorted, distinct)."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for batch in small_batches(batches):
        n, sums, keys = [], [], []
        for _, words in hashed_words(batch.column("text")):
            found = np.unique(shingles(words, SHINGLE))
            n.append(len(found))
            sums.append(digest(found) if len(found) else bytes(16))
            keys.append(bands(signature(found)) if len(found) else none)
        sizes = np.cumsum([0] + [len(x) for x in keys])
        flat = np.concatenate([none, *keys]).view(np.int64)
        both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
        columns = [
            batch.column("doc_id"),
            batch.column("text_hash"),
            pa.array(n, pa.int64()),
            pa.array(both[:, 0]),
            pa.array(both[:, 1]),
            pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "node", "check", "bands"])


def _sets(words: pa.Array) -> Iterator[np.ndarray]:
    for _, x in hashed_words(words):
        yield np.unique(shingles(x, SHINGLE))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, member): first the text of node a, then members b with a; gives the shared shingles."""
    current, first, size_a = None, np.zeros(0, np.uint64), 0
    for batch in small_batches(batches):
        out: list[tuple[int, int, int, int, int]] = []
        a, part, member, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "part", "member", "b"))
        for i, found in enumerate(_sets(batch.column("text"))):
            if not member[i]:
                current, first, size_a = (a[i], part[i]), found, len(found)
            elif current == (a[i], part[i]):
                at = np.searchsorted(first, found)
                shared = int((first[np.minimum(at, max(size_a - 1, 0))] == found).sum()) if size_a else 0
                out.append((int(a[i]), int(b[i]), shared, size_a, len(found)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["a", "b", "shared", "n_a", "n_b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with the sizes of their sets and of the intersection. The text of a comes once for every
    ``GROUP`` members, the members are dealt over these parts, so a hot node is no one task's work."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("parts"))
    firsts = counts.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), F.lit(False).alias("member"), F.col("a").alias("b")
    )
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "b")
    rows = firsts.unionByName(members).join(texts.withColumnRenamed("node", "b"), "b")
    rows = rows.select("a", "part", "member", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return rows.mapInArrow(_compare, "a long, b long, shared long, n_a long, n_b long")


_LINKED = f"100 * shared >= {PERCENT} * (n_a + n_b - shared)"


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each node's text."""
    for batch in small_batches(batches):
        sets = list(_sets(batch.column("text")))
        sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), pa.array(sizes), lists], ["node", "comp", "n", "shingles"])


def _largest_pivots(many: DataFrame) -> DataFrame:
    """Pairs (a, b): the largest node of each bucket with the bucket's nodes of other components."""
    chosen = many.groupBy("bucket").agg(F.max(F.struct(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))).alias("p"))
    met = many.join(chosen.select("bucket", "p.*"), "bucket").where("comp <> comp_a").where(_fits("n", "n_a"))
    return met.select("a", F.col("node").alias("b")).distinct()


def _fits(x: str, y: str) -> str:
    """Whether sets of two sizes can be similar enough."""
    return f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"


def _between_blocks(many: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components among the nodes (node, pivot, comp) of large buckets: every two nodes of a cluster
    of such buckets meet in one task. A node's set is sent once for each block of its cluster."""
    cluster = components(many.select(F.col("pivot").alias("a"), F.col("node").alias("b")), scratch, "cluster")
    nodes = many.select("node", "comp").distinct().join(cluster.withColumnRenamed("comp", "cluster"), "node")
    sets = nodes.select("node", "comp").join(texts, "node").mapInArrow(_shingle_sets, "node long, comp long, n long, shingles array<long>")
    sets = scratch.keep(sets.select("node", "shingles"), "sets")
    sizes = nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.transform(other, lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")))
    rows = dealt.select("cluster", "node", "comp", "own", F.explode(meets).alias("m")).select("cluster", "m.i", "m.j", "own", "node", "comp")
    return rows.join(sets, "node").groupBy("cluster", "i", "j").applyInArrow(_links_of_blocks, "a long, b long")


def _links_of_blocks(table: pa.Table) -> pa.Table:
    """Links between components of two blocks (or within one), a spanning forest of them."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    node, comp, own = (table.column(c).to_numpy() for c in ("node", "comp", "own"))
    lists = table.column("shingles").combine_chunks()
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    _, code = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
    holder, cuts = np.repeat(np.arange(len(node)), size), np.concatenate([[0], np.cumsum(size)])
    # Each set in order of how many of these sets hold a shingle; the first ones are its prefix.
    held = np.bincount(code)
    code = code[np.lexsort((code, held[code], holder))]
    length = size - -(-size * PERCENT // 100) + 1
    head = np.arange(len(code)) - cuts[holder] < length[holder]
    order = np.argsort(code[head], kind="stable")
    at, postings = np.searchsorted(code[head][order], np.arange(len(held) + 1)), holder[head][order]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = c = root.get(root[c], root[c])
        return c

    out, mark = [], np.zeros(len(held), bool)
    for x in np.flatnonzero(own == i):
        mine = code[cuts[x] : cuts[x + 1]]
        near = np.unique(np.concatenate([postings[at[k] : at[k + 1]] for k in mine[: length[x]]]))
        fits = (100 * np.minimum(size[near], size[x]) >= PERCENT * np.maximum(size[near], size[x])) & (own[near] == j) & (comp[near] != comp[x])
        near = near[fits & ((near > x) | (i != j))]
        if not len(near):
            continue
        mark[mine] = True
        for y in near:
            p, q = find(int(comp[x])), find(int(comp[y]))
            if p == q:
                continue
            shared = int(np.count_nonzero(mark[code[cuts[y] : cuts[y + 1]]]))
            if 100 * shared >= PERCENT * (size[x] + size[y] - shared):
                root[max(p, q)] = min(p, q)
                out.append((int(node[x]), int(node[y])))
        mark[mine] = False
    return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["a", "b"])


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component, with all their columns. Of rows that repeat doc_id and text,
    the one with the least hash of all its columns stays."""
    kept = near_duplicates(docs, with_text_hash=True).where("kept")
    own = uuid.uuid4().hex[:8]  # names that no column of the input has
    names, text, doc_id = [f"c{i}_{own}" for i in range(len(docs.columns))], f"text_{own}", f"id_{own}"
    plain = docs.toDF(*names)
    at_id, at_text = F.col(names[docs.columns.index("doc_id")]), F.col(names[docs.columns.index("text")])
    marked = plain.select("*", F.xxhash64(at_text.cast("string")).alias(text), at_id.cast("long").alias(doc_id))
    first = kept.select(F.col("doc_id").alias(f"first_{doc_id}"), F.col("text_hash").alias(f"first_{text}")).distinct()
    rows = marked.join(first, F.col(text).eqNullSafe(F.col(f"first_{text}")) & F.col(doc_id).eqNullSafe(F.col(f"first_{doc_id}")), "left_semi")
    hashed = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in plain.schema.fields]
    one = rows.groupBy(text, doc_id).agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias("row"))
    return one.select("row.*").toDF(*docs.columns)


def _nodes(sigs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Signatures and nodes (node, doc_id, text_hash, n, bands): one node for each different set. Should two sets share the
    first half of their digests, all but one of them take a node number of their own."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))

    def grouped(rows: DataFrame) -> DataFrame:
        found = rows.where("n_shingles > 0").groupBy("node").agg(
            least.alias("x"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.min("check").alias("c1"), F.max("check").alias("c2")
        )
        return found.select("node", "x.doc_id", "x.text_hash", "n", "bands", "c1", "c2")

    nodes = scratch.keep(grouped(sigs), "nodes")
    clash = nodes.where("c1 <> c2").select("node", "c1")
    if not clash.isEmpty():
        sigs = sigs.join(clash, "node", "left").withColumn(
            "node", F.when(F.col("check") != F.col("c1"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        )
        sigs = scratch.keep(sigs.drop("c1"), "signatures2")
        nodes = scratch.keep(grouped(sigs), "nodes2")
    return sigs, nodes.drop("c1", "c2")


def near_duplicates(docs: DataFrame, with_text_hash: bool = False) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_shingles, component_id, kept), one row each; ``with_text_hash`` adds
    text_hash, xxhash64 of the text."""
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    sigs = hashed.mapInArrow(_signatures, "doc_id long, text_hash long, n_shingles long, node long, check long, bands array<long>")
    sigs, nodes = _nodes(scratch.keep(sigs, "signatures"), scratch)
    rows = scratch.keep(nodes.select("node", "n", F.explode("bands").alias("bucket")), "rows")
    pivots = rows.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    met = scratch.keep(rows.join(pivots, "bucket"), "met")  # only buckets of two nodes or more
    scratch.drop("rows")
    pairs = scratch.keep(met.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs1")
    needed = met.select("node").distinct().join(nodes.select("node", "doc_id", F.col("text_hash").alias("own")), "node")
    # A document's id and the hash of its text: rows without an id are told apart, too.
    held = hashed.join(needed, hashed.doc_id.eqNullSafe(needed.doc_id) & (hashed.text_hash == needed.own)).select("node", "text")
    held = scratch.keep(held.mapInArrow(_once, "node long, text string").dropDuplicates(["node"]), "texts")
    known = scratch.keep(_verified(pairs, held), "known1")
    comp = components(known.where(_LINKED).select("a", "b"), scratch, "star")

    def still_open(comp: DataFrame) -> DataFrame:
        """Nodes of buckets that hold several components: (bucket, node, n, pivot, comp, c)."""
        at = met.join(comp, "node", "left").select("bucket", "node", "n", "pivot", F.coalesce("comp", "node").alias("comp"))
        several = at.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("c")).where("c1 <> c2")
        return at.join(several.select("bucket", "c"), "bucket")

    near = known.select(
        F.col("a").alias("pivot"), F.col("b").alias("node"), (1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("d")
    )
    at = scratch.keep(still_open(comp), "open1")
    few = at.where(f"c <= {SMALL} and node <> pivot").join(near, ["pivot", "node"])
    x, y = (few.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "comp", "d")]) for s in "xy")
    cross = x.join(y, "bucket").where("node_x < node_y and comp_x <> comp_y").where(_fits("n_x", "n_y")).where(
        f"abs(d_x - d_y) <= {1 - PERCENT / 100} + 1e-9"
    )
    cross = cross.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    many = at.where(f"c > {SMALL}")
    cross = scratch.keep(cross.unionByName(_largest_pivots(many)).distinct(), "pairs2")
    links = known.where(_LINKED).select("a", "b")
    if not cross.isEmpty():
        links = links.unionByName(scratch.keep(_verified(cross, held).where(_LINKED).select("a", "b"), "known2"))
        comp = components(links, scratch, "pivots")
        if not many.isEmpty():
            left = scratch.keep(still_open(comp).where(f"c > {SMALL}").select("node", "pivot", "comp").distinct(), "open2")
            if not left.isEmpty():
                links = links.unionByName(scratch.keep(_between_blocks(left, held, scratch), "known3"))
                comp = components(links, scratch, "all")
    least = nodes.select("node", "doc_id").join(comp, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = least.join(least.groupBy("comp").agg(F.min("doc_id").alias("least")), "comp").select("node", "least")
    out = sigs.select("doc_id", "text_hash", "n_shingles", "node").join(least, "node", "left")
    comp_id = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", *(["text_hash"] if with_text_hash else []), "n_shingles", comp_id.alias("component_id"),
        F.col("doc_id").eqNullSafe(comp_id).alias("kept")
    )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops repeats of a node within a batch: repeated rows of one document."""
    for batch in batches:
        node = batch.column("node").to_numpy()
        yield batch.take(pa.array(np.sort(np.unique(node, return_index=True)[1])))
