"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.tables import dealt, discarded, importable, written

#: Edges that one task joins together; more of them are contracted first.
SMALL = 1 << 17


def _turned(x: Column) -> Column:
    """Another number for each 64-bit number, in another order: an xorshift step, which is one to one."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with numbers (u, v), and nodes (node, id). Numbers are hashes; if two nodes had one, others are taken."""
    for seed in range(8):
        number = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        own = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
        nodes = written(own.select("node", number("node").alias("id")), "nodes")
        if not nodes.groupBy("id").count().filter("count > 1").limit(1).count():
            return edges.select(number("u").alias("u"), number("v").alias("v")), nodes
    raise RuntimeError("components: hashes are not distinct")


def _simple(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the few edges of one task: each node and one of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["u", "to"])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (u, v).

    Contraction: each round every node joins the one of itself and its neighbours that comes first in an order of the
    round's own, and only edges between different nodes are left, so that tables shrink by a share each round, and a
    long chain takes as few rounds as a star. The last few edges are joined in one task. Then each round's table leads
    its nodes to what became of theirs. No step gathers a node's neighbours; the first is an aggregate, so Spark can
    split the join back to the edges.
    """
    importable(edges.sparkSession)
    pairs = written(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL"), "pairs")
    now, nodes = _numbered(pairs)
    now, steps = written(_simple(now), "edges"), []
    discarded(pairs)
    while (left := now.count()) > SMALL:
        if len(steps) == rounds:
            raise RuntimeError(f"components: {left} edges are left")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = written(both.groupBy("u").agg(F.least(F.min(_turned(F.col("v"))), _turned(F.col("u"))).alias("to")), "step")
        a, b = (dealt(step.select(F.col("u").alias(k), F.col("to").alias(f"_{k}"))) for k in "uv")
        small = written(_simple(now.join(a, "u").join(b, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))), "edges")
        discarded(now)
        now = small
        steps.append(step)
    led = now.repartition(1).mapInArrow(_joined, "u long, to long")
    for later, step in enumerate(reversed(steps)):
        # where a node led to has no edge any more, it keeps its number, in the order of the later rounds
        done = F.col("to")
        for _ in range(later):
            done = _turned(done)
        led = step.join(dealt(led.select(F.col("u").alias("to"), F.col("to").alias("_to"))), "to", "left").select("u", F.coalesce("_to", done).alias("to"))
    alone = F.col("id")
    for _ in steps:
        alone = _turned(alone)
    placed = written(nodes.join(dealt(led.select(F.col("u").alias("id"), "to")), "id", "left").select("node", F.coalesce("to", alone).alias("to")), "placed")
    discarded(now, nodes, *steps)
    return placed.join(dealt(placed.groupBy("to").agg(F.min("node").alias("root"))), "to").select("node", "root")
