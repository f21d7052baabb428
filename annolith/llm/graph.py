"""Connected components of edges in tables, by labels that shrink and jump."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


class Forest:
    """Union-find inside one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        r = p.setdefault(x, x)
        while p[r] != r:
            r = p[r]
        while p[x] != r:
            p[x], x = r, p[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Every node that isn't a root, and its root."""
        got = [(x, self.find(x)) for x in list(self.parent)]
        got = np.array([(x, r) for x, r in got if x != r], np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]


def components(edges: DataFrame, tag: str) -> DataFrame:
    """edges: a, b (long). Returns node, label: the smallest node that edges reach.

    Each round a node takes the smallest label among its neighbours and its own, then the label
    of that label, so a path of any length takes about as many rounds as its length has binary
    digits. Every round is written, and both sides of a join are read from tables, so a node
    with very many edges is split by Spark's skew join.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = storage.materialize(both, f"{tag}-edges")
    labels = storage.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), f"{tag}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        new = storage.materialize(new, f"{tag}-near")
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = storage.materialize(new.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), f"{tag}-labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels
