"""Connected components of a distributed edge list, and groups streamed from sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: A vertex is a hub if it has more than HUB edges and more than one in HUBS of all edge ends; so there are fewer than HUBS hubs.
HUB, HUBS = 100_000, 10_000


def beside(rows: DataFrame, key: str, one: DataFrame, name: str, limit: int | None) -> DataFrame:
    """Inner join of the rows with the one row of their key in ``one``, where it is called ``name`` and has its number of rows in ``n``.

    Rows of keys with more than ``limit`` stay where they are: the few hubs are broadcast, and only the other rows are
    shuffled by key. Without a limit no key can have that many.
    """
    on = F.col(key) == F.col(name)
    if limit is None:
        return rows.join(one.drop("n"), on)
    hubs = F.broadcast(one.where(F.col("n") > limit).drop("n"))
    return rows.join(hubs, on).unionByName(rows.join(hubs, on, "left_anti").join(one.where(F.col("n") <= limit).drop("n"), on))


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(id, root) for each vertex of the edges (a, b): root is the smallest id of its component.

    Alternates large-star and small-star until the edges stay as they are. Every step is an
    aggregate and a join on the vertex, in which the edges of hubs are not brought together; each
    round is written, so the lineage stays short. The number of edges never grows.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        sign = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
        found = tuple(now.agg(F.count(F.lit(1)), sign).first())
        if found == mark:
            break
        mark = found
        limit = max(hub, 2 * found[0] // HUBS) if 2 * found[0] > hub else None
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"), "n")
        large = beside(both, "a", low, "v", limit).where("b > a").select(F.col("b").alias("u"), "m").distinct()
        # small-star: u > m in every edge; u's smallest neighbour takes u and its other neighbours
        least = large.groupBy("u").agg(F.min("m").alias("r"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("w"), "r", "n")
        met = beside(large, "u", least, "w", limit)
        small = met.where("m <> r").select(F.col("r").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("r").alias("a"), F.col("w").alias("b")))
        after = written(small.distinct())
        discard(now)
        now = after
    return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Each run of rows that are equal in the first ``keys`` (long) columns, from batches sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not len(table):
            continue
        change = np.zeros(len(table) - 1, bool)
        for k in range(keys):
            x = table.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        if len(cuts) > 1:
            table = table.combine_chunks()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a graph, given as a symmetric boolean matrix."""
    n = len(near)
    if n == 2:
        return (np.array([0]), np.array([1])) if near[0, 1] else (np.zeros(0, int), np.zeros(0, int))
    left = np.ones(n, bool)
    from_, to = [], []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            u = queue.pop()
            new = np.flatnonzero(near[u] & left)
            if len(new):
                left[new] = False
                from_.append(np.full(len(new), u))
                to.append(new)
                queue += new.tolist()
    return (np.concatenate(from_), np.concatenate(to)) if to else (np.zeros(0, int), np.zeros(0, int))
