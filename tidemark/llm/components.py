"""Connected components of a link table, by minimum labels, as Spark joins over written tables.

A link with a null end is no link; repeated links and loops change nothing; a table without links has no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remove, written

#: Links that are contracted together, in a task's memory.
CHUNK = 1 << 19


def reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that it reaches over the links."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = np.minimum(new, new[new])
        np.minimum.at(new, least, new)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _contracted(links: DataFrame) -> DataFrame:
    """``u``, ``v`` that join the same nodes as the links of a written table do: in each chunk, every node and the least that it reaches.

    A task takes files of about one chunk together, so that few large stars are left of a small table, whatever number of files it has.
    """
    tasks = -(-links.count() // CHUNK)

    def star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        least = reached(len(nodes), at[: len(u)], at[len(u) :])
        other = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[least[other]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield star(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield star(*map(np.concatenate, zip(*held, strict=True)))

    return links.select("u", "v").coalesce(max(1, tasks)).mapInArrow(run, "u bigint, v bigint")


def _ordered(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links with the larger end first; loops go."""
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    return ends.where("u <> v").distinct()


def components(links: DataFrame, folder: str, a: str = "u", b: str = "v") -> DataFrame:
    """``node``, ``label`` for every node that has a link; the label is the least node that it can reach.

    Chunks of links are contracted to stars where they lie before each round. In a round each node hands its links to smaller nodes over to the least of them, until every node
    has one smaller neighbour: rows are grouped by the larger end only, so that a node with
    very many larger neighbours is never a group. Then parents are replaced by their own
    parents until all point at roots. Every round is written below ``folder`` and ends lineage.
    """
    spark = links.sparkSession
    path = f"{folder}/links-0"
    held = _contracted(written(_ordered(links, a, b), path))
    turn = 0
    while True:
        turn += 1
        parent = held.groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("n"))
        several = written(parent, f"{folder}/parents-{turn}")
        if several.where("n > 1").isEmpty():
            break
        handed = held.join(several, "u").where("v <> p").select(F.col("v").alias("a"), F.col("p").alias("b"))
        merged = handed.unionByName(several.select(F.col("u").alias("a"), F.col("p").alias("b")))
        new = f"{folder}/links-{turn}"
        held = _contracted(written(_ordered(merged, "a", "b"), new))
        remove(spark, path)
        remove(spark, f"{folder}/parents-{turn}")
        path = new
    remove(spark, path)
    forest = several.select("u", "p")
    while True:
        turn += 1
        path = f"{folder}/inner-{turn}"
        inner = written(forest.join(forest.select(F.col("p").alias("u")).distinct(), "u", "left_semi"), path)
        if inner.isEmpty():
            break
        hops = inner.select(F.col("u").alias("p"), F.col("p").alias("up"))
        new = f"{folder}/parents-{turn}"
        forest = written(forest.join(hops, "p", "left").select("u", F.coalesce("up", "p").alias("p")), new)
        remove(spark, path)
    roots = forest.select(F.col("p").alias("node")).distinct()
    return forest.select(F.col("u").alias("node"), F.col("p").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
