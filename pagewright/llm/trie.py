"""Conversation prefix trie by burst tries.

Every conversation is a sequence of turns (role, text); equal sequences are one
with a weight and the least id. A container holds the suffixes of all
sequences under one trie head. It starts at the root; while a container holds
more than ``CONTAINER`` turns of two sequences or more, it bursts by its next
turn id: its head becomes an inner node and every next turn the head of a
smaller container. The others are dealt to tasks (shards), sorted and swept
into nodes with a stack. A container of a single sequence, however long, needs
no sweep: its nodes are the rows of its turns. Sums over subtrees go up from
the containers through the burst heads, one level at a time.

Turn ids are 128-bit digests of role and text, heads 128-bit digests of the
path. No group is collected whole: turns are numbered and ids joined in range
slices, containers are bounded, burst heads are sums. A sequence longer than
``CONTAINER`` that shares a long head with another bursts once per shared
turn.

Defined cases: a null role or text is empty; turns go by ``turn`` (null
first), ties by role, the first ``OPENING`` characters, then the digest;
repeated rows are repeated turns; rows with a null conv_id belong to no
conversation; a table without conversations has no node, not even the root;
columns other than conv_id, turn, role and text are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import scratch_table
from pagewright.llm.graph import group_runs
from pagewright.operators.order import rank_within, running_total

CONTAINER = 4096
BASE, HEAD = 100, 6
ID_SLICE = 512
OPENING = 64             # characters that order turns of equal number and role
_ROOT = bytes(16)
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends long")


def turn_id(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))


def path_id(head: Column, turn: Column) -> Column:
    return F.unhex(F.md5(F.concat(head, turn)))


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, d, tid, chars): the turns of every conversation, numbered."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = scratch_table(rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("given"), "turn",
        role.alias("role"), F.substring(text, 1, OPENING).alias("opening"),
        turn_id(role, text).alias("tid"), F.length(text).cast("long").alias("chars")), "trie-turns")
    ordered = rank_within(turns, ["conv_id"], [(c, True) for c in ("given", "turn", "role", "opening", "tid")], "d")
    return ordered.select("conv_id", F.col("d").cast("long").alias("d"), "tid", "chars")


def rebuilt(rows: DataFrame, base: int = BASE, head: int = HEAD) -> DataFrame:
    """(conv_id, d, tid, chars) of conversations that begin with the first h
    turns of the conversation at the start of their hundred; and one row of
    every conversation with d = 0."""
    own = scratch_table(ordered_turns(rows), "trie-ordered")
    convs = own.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % base).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).alias("h"))
    heads = own.where(F.col("d") < head).select(F.col("conv_id").alias("base"), "d", "tid", "chars")
    first = convs.join(heads, "base").where("d <= h")
    taken = first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    rest = (own.join(convs.select("conv_id", "h"), "conv_id").join(taken, "conv_id", "left").where("d > h")
            .select("conv_id", (F.col("d") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("d"), "tid", "chars"))
    none = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("tid"),
                        F.lit(0).cast("long").alias("chars"))
    return first.select("conv_id", "d", "tid", "chars").unionByName(rest).unionByName(none)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): every conversation and the least one equal to it."""
    both = [F.bit_xor(F.when(F.col("d") > 0, F.xxhash64(F.lit(salt), "tid", "d")).otherwise(F.lit(0))).alias(f"x{salt}")
            for salt in (1, 2)]
    shape = turns.groupBy("conv_id").agg(F.max("d").alias("size"), *both)
    least = shape.groupBy("size", "x1", "x2").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight"))
    return shape.join(least, ["size", "x1", "x2"]).select("conv_id", "seq", "size", "weight")


def id_lists(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256): the digest of the ids of equal conversations in
    order. Slices of ids are joined where they lie in range partitions of (seq,
    conv_id); one task streams the slices of a sequence through the hash."""
    def joined(batches):
        for rows in group_runs(batches, ["seq"]):
            ids = rows["conv_id"].to_pylist()
            cuts = range(0, len(ids), ID_SLICE)
            yield pa.RecordBatch.from_arrays(
                [rows["seq"].combine_chunks().slice(0, len(cuts)), pa.array([ids[c] for c in cuts], pa.int64()),
                 pa.array([",".join(map(str, ids[c:c + ID_SLICE])) for c in cuts], pa.string())], names=["seq", "first", "ids"])

    def hashed(batches):
        name, state = None, None
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq == name:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done.append((name, state.hexdigest()))
                name, state = seq, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                             names=["seq", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([state.hexdigest()])], names=["seq", "ends_sha256"])

    slices = (members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
              .mapInArrow(joined, "seq long, first long, ids string"))
    return (slices.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "ids")
            .mapInArrow(hashed, "seq long, ends_sha256 string"))


def sweep(depth: int, seqs: list[tuple], top_chars: int) -> list[list]:
    """The nodes of one container, its head first in depth-first order.
    ``seqs``: (turn ids, chars, conv_id, weight) of every suffix under the
    head; ``depth`` and ``top_chars`` of the head itself. Rows as in ``NODE``,
    the head's parent is null."""
    nodes, stack, before = [], [], ()

    def open_node(chars):
        # conv_id, depth, parent, n_convs, children, leaves, saved, ends, chars of the last turn
        row = [None, depth + len(stack), None, 0, 0, 0, 0, None, chars]
        nodes.append(row)
        stack.append(row)

    def close_node():
        row = stack.pop()
        row[5] = row[5] or 1
        row[6] += max(row[3] - 1, 0) * row[8]
        if stack:
            up = stack[-1]
            up[4] += 1
            for k in (3, 5, 6):
                up[k] += row[k]
            up[0] = row[0] if up[0] is None else min(up[0], row[0])

    open_node(top_chars)
    for ids, chars, conv_id, weight in sorted(seqs, key=lambda s: s[0]):
        same = 0
        while same < min(len(ids), len(before)) and ids[same] == before[same]:
            same += 1
        while len(stack) > same + 1:
            close_node()
        for c in chars[same:]:
            open_node(c)
        top = stack[-1]
        top[0] = conv_id if top[0] is None else min(top[0], conv_id)
        top[3] += weight
        top[7] = conv_id
        before = ids
    while stack:
        close_node()
    # every parent is open when its child opens: hand down its least member
    path = []
    for row in nodes:
        del path[row[1] - depth:]
        row[2] = path[-1][0] if path else None
        path.append(row)
    return [row[:8] for row in nodes]


def swept(closed: DataFrame, turns: DataFrame) -> DataFrame:
    """``NODE`` rows of all containers of ``closed`` (head, up, at, top, seq,
    weight: a container's head, the head above, its depth, the characters of
    its last turn, and the sequences in it); ``up`` on the rows of the heads."""
    dealt = (closed.join(turns, "seq").where("d > at or d = 0")
             .repartition("head").sortWithinPartitions("head", "seq", "d"))

    def run(batches):
        for rows in group_runs(batches, ["head"]):
            tid, chars, d = rows["tid"].to_pylist(), rows["chars"].to_pylist(), rows["d"].to_numpy()
            seq, weight = rows["seq"].to_numpy(), rows["weight"].to_numpy()
            first = np.flatnonzero(d == 0)
            last = np.append(first[1:], len(d))
            seqs = [(tuple(tid[a + 1:b]), chars[a + 1:b], int(seq[a]), int(weight[a])) for a, b in zip(first, last, strict=True)]
            out = sweep(rows["at"][0].as_py(), seqs, rows["top"][0].as_py())
            up = [rows["up"][0].as_py(), *[None] * (len(out) - 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(8)), pa.array(up, pa.binary())],
                                             names=[*(c.split()[0] for c in NODE.split(", ")), "up"])

    return dealt.select("head", "up", "at", "top", "seq", "weight", "d", "tid", "chars").mapInArrow(run, NODE + ", up binary")


def long_single(alone: DataFrame, turns: DataFrame) -> DataFrame:
    """The same for containers of one sequence: a node per turn."""
    rows = alone.join(turns, "seq").where("d >= at").select("seq", "d", "chars", "at", "up", "weight", "size")
    below = running_total(rows, ["seq"], [("d", False)], "chars", "below")
    own = F.col("d") == F.col("at")
    return below.select(
        F.col("seq").alias("conv_id"), F.col("d").alias("depth"), F.when(~own, F.col("seq")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), (F.col("d") < F.col("size")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * F.col("below")).alias("saved_tokens"),
        F.when(F.col("d") == F.col("size"), F.col("seq")).alias("ends"), F.when(own, F.col("up")).alias("up"))


def burst(seqs: DataFrame, turns: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(finished ``NODE`` rows with ``up``, the burst heads of every level)."""
    held = seqs.select("seq", "size", "weight", F.lit(_ROOT).alias("head"), F.lit(None).cast("binary").alias("up"),
                       F.lit(0).cast("long").alias("top"))
    closed, alone, bursts, level = [], [], [], 0
    while True:
        held = scratch_table(held, "trie-held")
        box = scratch_table(held.groupBy("head", "up").agg(
            F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("size") == level, F.col("seq"))).alias("ends"),
            F.max("top").alias("top"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size") - level).alias("n_turns")), "trie-boxes")
        large = F.col("n_turns") > CONTAINER
        at = held.join(box.select("head", (large & (F.col("n") > 1)).alias("split"), (large & (F.col("n") == 1)).alias("single")), "head")
        closed.append(at.where("not split and not single").select("head", "up", F.lit(level).cast("long").alias("at"), "top", "seq", "weight"))
        alone.append(at.where("single").select("head", "up", F.lit(level).cast("long").alias("at"), "seq", "weight", "size"))
        heads = box.where(large & (F.col("n") > 1))
        if heads.limit(1).count() == 0:
            break
        bursts.append(heads.select("head", "up", "conv_id", "n_convs", "ends", "top"))
        below = turns.where(F.col("d") == level + 1).select("seq", "tid", "chars")
        held = (at.where("split").where(F.col("size") > level).join(below, "seq")
                .select("seq", "size", "weight", path_id(F.col("head"), F.col("tid")).alias("head"), F.col("head").alias("up"),
                        F.col("chars").alias("top")))
        level += 1
    done = swept(_union(closed), turns)
    rest = _union(alone)
    if rest.limit(1).count():
        done = done.unionByName(long_single(rest, turns))
    return scratch_table(done, "trie-swept"), bursts


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_trie(rows: DataFrame, base: int = BASE, head: int = HEAD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    all_turns = scratch_table(rebuilt(rows, base, head), "trie-rebuilt")
    members = scratch_table(sequences(all_turns), "trie-members")
    seqs = members.where("conv_id = seq").select("seq", "size", "weight")
    turns = scratch_table(all_turns.withColumnRenamed("conv_id", "seq").join(seqs.select("seq"), "seq", "left_semi"), "trie-suffixes")
    done, bursts = burst(seqs, turns)
    nodes, below = [done], done.where("up is not null").select("up", "n_leaves", "saved_tokens")
    for level in range(len(bursts) - 1, -1, -1):
        sums = below.groupBy(F.col("up").alias("head")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                                                            F.sum("saved_tokens").alias("below"))
        inner = scratch_table(bursts[level].join(sums, "head").select(
            "conv_id", F.lit(level).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            "n_children", "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("top")).alias("saved_tokens"), "ends", "up", "head"),
            "trie-inner")
        nodes.append(inner.drop("head"))
        below = below.unionByName(inner.where("up is not null").select("up", "n_leaves", "saved_tokens"))
    every = _union(nodes)
    if bursts:
        above = _union(bursts).select(F.col("head").alias("up"), F.col("conv_id").alias("above"))
        every = (every.where("up is null").drop("up").unionByName(
            every.where("up is not null").drop("parent_conv_id").join(above, "up").withColumnRenamed("above", "parent_conv_id").drop("up")))
    else:
        every = every.drop("up")
    lists = id_lists(members)
    none = hashlib.sha256(b"").hexdigest()
    ended = every.where("ends is not null").join(lists.withColumnRenamed("seq", "ends"), "ends")
    return (ended.unionByName(every.where("ends is null").withColumn("ends_sha256", F.lit(none)))
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
