"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all links in one task, comp the least node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(up.setdefault(a, a) if a not in up else a), root(up.setdefault(b, b) if b not in up else b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array([root(x) for x in nodes], type=pa.int64())], ["node", "comp"])


def components(edges: DataFrame, one_task: int = 2_000_000) -> DataFrame:
    """Rows (node, comp) for all ends of ``edges`` (a, b); comp is the least node of a component.

    Up to ``one_task`` links, counted first, are joined in a task; more are contracted: each round maps every node to the least of itself and its neighbours and contracts the
    links by that map. Stars vanish in one round and chains shrink at least by half. Rounds are
    written between; nothing goes to the driver but whether links are left.
    """
    comp = None
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), narrow=True)
    if edges.count() <= one_task:
        return materialize(edges.coalesce(1).mapInArrow(_joined, "node long, comp long"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to")), narrow=True)
        if comp is None:
            comp = step.withColumnRenamed("to", "comp")
        else:
            hop = step.select(F.col("node").alias("comp"), "to")
            comp = comp.join(hop, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(left, "a").join(right, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        edges = materialize(edges, narrow=True)
        if edges.isEmpty():
            least = comp.groupBy("comp").agg(F.min("node").alias("least"))
            return materialize(comp.join(least, "comp").select("node", F.col("least").alias("comp")), narrow=True)


def extended(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, comp) after more links (a, b)."""
    x, y = (comp.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}")) for c in "ab")
    joined = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    more = components(joined)
    hop = more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = comp.join(hop, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return materialize(old.union(more.join(comp, "node", "left_anti").select("node", "comp")), narrow=True)
