"""Links inside large groups, cut into blocks, and connected components.

Nodes are longs that the caller gives out once. A group of more members than a
block holds is cut into blocks by a hash of the node, and every pair of blocks
is one task's work: no task holds a whole group. A member is copied n / block
times, pairs of members never become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import scratch_table
from pagewright.operators.components import components  # noqa: F401


def numbered(df: DataFrame, name: str, node: str = "node") -> DataFrame:
    """``df`` as a table of the shared folder with a unique long per row."""
    return scratch_table(df.withColumn(node, F.monotonically_increasing_id()), name)


def in_blocks(members: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Members dealt to the pairs of blocks of their group and sorted by
    them: ``i`` <= ``j`` are the blocks, ``at`` the member's own one. The
    number of blocks is raised to a power of two, so that groups of similar
    size cut the same members alike."""
    n = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(blocks.cast("double"), F.lit(1.0))))).cast("int")
    dealt = (members.withColumn("_n", n).withColumn("at", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
             .select("*", F.least("at", "_o").alias("i"), F.greatest("at", "_o").alias("j")).drop("_n", "_o"))
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")


def group_runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one group after another, from batches sorted by it."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[lo].as_py() for c in columns)
            if key != name and held:
                yield pa.Table.from_batches(held)
                held = []
            name = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def labels(members: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The least member of the component of every one of the sorted
    ``members``; ``near(i, open)`` gives those of the open ones linked with
    i. A member that is found is never compared as an open one again."""
    least, left = members.copy(), members
    where = {int(m): k for k, m in enumerate(members)} if len(members) else {}
    while len(left):
        first, left = int(left[0]), left[1:]
        stack = [first]
        while stack and len(left):
            hit = near(stack.pop(), left)
            if len(hit):
                least[[where[int(h)] for h in hit]] = first
                stack.extend(hit.tolist())
                left = left[~np.isin(left, hit)]
    return least


def forest_edges(at: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what a pair of blocks links. ``at`` is the block of
    every member; members are in order. One block: every member with the least
    of its component. Two blocks: what one block links is one component (its
    own task emits its edges), and only edges between components of different
    blocks leave, each joining two that nothing here had joined."""
    if at[0] == at[-1] and (at == at[0]).all():
        least = labels(np.arange(len(at)), near)
        return [(int(a), int(b)) for b, a in enumerate(least) if a != b]
    least, both = np.zeros(len(at), np.int64), np.unique(at)
    for b in both:
        own = np.flatnonzero(at == b)
        least[own] = labels(own, near)
    out, left = [], np.arange(len(at))
    while len(left):
        start = least[left[0]]
        stack = left[least[left] == start].tolist()
        left = left[least[left] != start]
        while stack and len(left):
            i = stack.pop()
            other = left[at[left] != at[i]]
            hit = near(i, other) if len(other) else other
            for root in np.unique(least[hit]):
                out.append((int(least[i]), int(root)))
                stack.extend(left[least[left] == root].tolist())
                left = left[least[left] != root]
    return out


def edge_batch(node: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])
