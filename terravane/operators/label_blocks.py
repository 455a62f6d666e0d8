"""Rounds of label propagation over blocks of nodes.

A block's edges lie in one row of the shared folder and are not moved. A round moves the label of a node once to each
block in which it has neighbours, not along each edge, and without its name: edges are known at both ends, so either block lists the same nodes
in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import bucketed

BLOCK_EDGES = 2_000_000  #: Edges of a block, each counted at both ends.
OWN = -1  #: Sender of a block's own labels.


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, all first ones before all second ones, which compress better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def numbers(held, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(held.as_buffer(), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return np.flatnonzero(new)


def packed(pairs: DataFrame, blocks: int) -> DataFrame:
    """A row a block: its nodes with their number of neighbours, and for each neighbour its place (at) among those of the block (known), which are sorted by block and number."""

    def pack(t: pa.Table) -> pa.Table:
        node, other, weight = (t[c].to_numpy() for c in ("node", "other", "weight"))
        order = np.argsort(node, kind="stable")
        node, other, weight = node[order], other[order], weight[order]
        nodes, count = np.unique(node, return_counts=True)
        far = other % blocks
        order = np.lexsort((other, far))
        first = starts(other[order], far[order])
        at = np.empty(len(other), np.int32)
        at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(other))))
        sender, n = np.unique(far[order][first], return_counts=True)
        held = {"nodes": nodes, "counts": count, "known": other[order][first], "senders": sender, "sent": n, "at": at, "weights": weight}
        return pa.table({"block": [int(t["block"][0].as_py())]} | {c: pa.array([planes(x)], pa.binary()) for c, x in held.items()})

    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "weight"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))).alias("e")).select("e.*")
    dealt = ends.withColumn("block", F.pmod("node", F.lit(blocks).cast("long"))).repartition(blocks, "block")
    rows = dealt.groupBy("block").applyInArrow(pack, "block long, nodes binary, counts binary, known binary, senders binary, sent binary, at binary, weights binary")
    return bucketed(rows, "blocks", "block", blocks, dealt=True)


def chosen(count: np.ndarray, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each node the vote of most weight, the least of equal ones; weights are added up to six decimals, and votes without one come last."""
    node = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((votes, node))
    node, votes, weight = node[order], votes[order], weight[order]
    first, has = starts(node, votes), ~np.isnan(weight)
    total = np.floor(np.add.reduceat(np.where(has, weight, 0.0), first) * 1e6 + 0.5)
    total[~np.logical_or.reduceat(has, first)] = -np.inf
    node, votes = node[first], votes[first]
    best = np.flatnonzero(total == np.maximum.reduceat(total, starts(node))[node])
    return votes[best][starts(node[best])]


def one_round(i: int, last: bool):
    """The function of round i: of a block's edges and what it was sent, what it sends or, at last, its labels."""

    def run(edges: pa.Table, sent: pa.Table | None = None) -> pa.Table:
        held = {c: numbers(edges[c][0], kind) for c, kind in (("nodes", "<i8"), ("counts", "<i8"), ("senders", "<i8"), ("sent", "<i8"), ("at", "<i4"), ("weights", "<f8"))}
        nodes, count, at = held["nodes"], held["counts"], held["at"]
        if sent is None:
            labels, known = nodes, numbers(edges["known"][0], "<i8")
        else:
            told = {s: numbers(x, "<i8") for s, x in zip(sent["sender"].to_pylist(), sent["labels"])}
            labels, known = told[OWN], np.concatenate([told[s] for s in held["senders"].tolist()])
        vote = chosen(count, known[at], held["weights"])
        labels = vote if i % 2 == 0 else np.minimum(vote, labels)
        if last:
            return pa.table({"node": nodes, "label": labels})
        # The other way each block is told about the nodes that have neighbours in it.
        to = np.repeat(np.arange(len(held["senders"])), held["sent"])[at]
        told = np.unique(to * len(nodes) + np.repeat(np.arange(len(nodes)), count))
        cuts = np.searchsorted(told, np.arange(1, len(held["senders"])) * len(nodes))
        parts = [planes(x) for x in np.split(labels[told % len(nodes)], cuts)]
        me = int(edges["block"][0].as_py())
        return pa.table({"block": pa.array([me, *held["senders"].tolist()], pa.int64()), "sender": pa.array([OWN] + [me] * len(parts), pa.int64()), "labels": pa.array([planes(labels), *parts], pa.binary())})

    return run


def propagated(blocks: DataFrame, rounds: int) -> DataFrame:
    """node, label after rounds (one at least) over packed() blocks."""
    kind = lambda i: "node long, label long" if i == rounds - 1 else "block long, sender long, labels binary"
    first = one_round(0, rounds == 1)
    told = blocks.groupBy("block").applyInArrow(lambda edges: first(edges), kind(0))
    edges = blocks.drop("known")
    for i in range(1, rounds):
        told = edges.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(one_round(i, i == rounds - 1), kind(i))
    return told
