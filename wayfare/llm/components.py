"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Edges that one task joins at once, at most: rounds of several jobs each, over a few edges, fill the driver with plans.
FEW = 16_384


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges (a, b) of longs to rows (node, comp), comp the smallest node reachable; only nodes of some edge occur.

    Each round hooks every label to the smallest label next to it, follows the hooks once more (pointer jumping), and
    contracts edges to labels; edges inside a label vanish, so the work shrinks. Once ``FEW`` edges or less are left, one
    task finishes them. An empty table gives an empty table.
    """
    live = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    labels, k = None, 0
    while live.count() > FEW:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("to"))
        hook = scratch.keep(hook, f"{name}-hook{k}")
        far = hook.select(F.col("v").alias("to"), F.col("to").alias("to2"))
        hook = hook.join(far, "to", "left").select("v", F.coalesce("to2", "to").alias("to"))
        if labels is None:
            labels = hook.select(F.col("v").alias("node"), F.col("to").alias("comp"))
        else:
            labels = labels.join(hook, labels.comp == hook.v, "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = scratch.keep(labels, f"{name}-labels{k}")
        ha, hb = hook.select(F.col("v").alias("a"), F.col("to").alias("ta")), hook.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        nxt = live.join(ha, "a").join(hb, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        nxt = scratch.keep(nxt, f"{name}-edges{k + 1}")
        scratch.drop(f"{name}-edges{k}", f"{name}-hook{k}", *([f"{name}-labels{k - 1}"] if k else []))
        live, k = nxt, k + 1
    last = scratch.keep(live.coalesce(1).mapInArrow(_finished, "v long, to long"), f"{name}-last")
    if labels is None:
        return last.select(F.col("v").alias("node"), F.col("to").alias("comp"))
    return scratch.keep(labels.join(last, labels.comp == last.v, "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{name}-labels")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node reachable."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = sorted(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(v) for v in nodes], pa.int64())], ["v", "to"])
