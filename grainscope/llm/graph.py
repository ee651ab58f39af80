"""Connected components of a table of links, by alternating star operations on the links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscope.session import save_and_reload, shared_dir


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for all nodes with a link; the component is named by its smallest node.

    Each round hangs the larger neighbours of every node, then the smaller ones, under its smallest neighbour; the
    minimum is found by partial aggregation and joined back, so a node with very many links is spread over tasks.
    Rounds are written to the shared folder. Their number grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    folder = shared_dir(spark)
    edges = save_and_reload(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{folder}/0")
    before, turn = None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = state
        # large star: all neighbours of a node, in both directions, larger ones move
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turn += 1
        edges = save_and_reload(large.where("u <> v").distinct(), f"{folder}/{turn}")
        # small star: a node and its smaller neighbours move under the smallest
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        turn += 1
        edges = save_and_reload(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{folder}/{turn}")


def local_links(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what a block of links connects: (id, smallest id of its connected part).

    ``linked[i, j]`` links rows[i] and columns[j]; ids without a link are left out.
    """
    none = np.iinfo(np.int64).max
    a, b = rows.astype(np.int64), columns.astype(np.int64)
    while True:
        to_a = np.where(linked, b[None, :], none).min(axis=1, initial=none)
        a2 = np.minimum(a, to_a)
        b2 = np.minimum(b, np.where(linked, a2[:, None], none).min(axis=0, initial=none))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    some, other = linked.any(axis=1), linked.any(axis=0)
    pairs = np.unique(np.stack([np.concatenate([rows[some], columns[other]]), np.concatenate([a[some], b[other]])]), axis=1)
    return pairs[0], pairs[1]
