"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import drop, written

#: edges that a task reduces at once
SLICE = 1 << 20


class Forest:
    """Union-find over 0..n-1, for the links found inside one task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> list[int]:
        """Unites x with the others; those that brought a new tree in."""
        grown = []
        roots, at = np.unique(self.label[others], return_index=True)
        for root, i in zip(roots.tolist(), at.tolist(), strict=True):
            mine = self.label[x]
            if root != mine:
                grown.append(int(others[i]))
                self.label[self.label == max(root, mine)] = min(root, mine)
        return grown


def release(spark) -> None:
    """Lets Spark delete shuffle files of results that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges connect: every node but the smallest of its component, and that one."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        if np.array_equal(low, root[x]) and np.array_equal(low, root[y]):
            break
        for end in (x, y):
            np.minimum.at(root, root[end], low)
            np.minimum.at(root, end, low)
        while not np.array_equal(following := root[root], root):
            root = following
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b: the edges, ``SLICE`` at most at a time reduced to stars."""

    def each(batches):
        held, size = [], 0

        def stars():
            a, b = contract(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(2)])
            size += batch.num_rows
            if size >= SLICE:
                yield stars()
                held, size = [], 0
        if size:
            yield stars()

    return edges.mapInArrow(each, "a long, b long")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return int(row["n"]), int(row["s"])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (the component's smallest node) of every node that has an edge.

    edges: (a, b) long; direction, loops and repetitions do not matter.  Tasks reduce
    their own edges to stars before every round.  Every round is
    written to the shared folder, so a lost executor repeats one round at most.
    """
    now = written(_contracted(edges.where("a != b").select("a", "b")), "edges")
    before = None
    for _ in range(most):
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()  # a plain join, so that Spark can split the centre of a large star
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        following = written(_contracted(small), "edges")
        after = _state(following)
        drop(now)
        now = following
        if after == before or after[0] == 0:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
