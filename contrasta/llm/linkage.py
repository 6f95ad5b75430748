"""Components of a similarity graph without its full list of pairs.

Items that share a key are candidates. Each group of a key has a hub, and each item is first compared with one of its
hubs, so a group of n copies costs n comparisons; the links that hold are contracted to components, and items are compared
with their other hubs only across components. Only candidates that are then in different components are compared pair by
pair, so no link between components is missed and no group is expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, bounded, discard, lean, stash, tidy

#: Rounds of comparisons with a hub before the rest is compared pair by pair.
HUB_ROUNDS = 2
#: Edges of which one task finds the components (16 bytes each); more are contracted by joins.
TASK_EDGES = 250_000
#: Groups up to this size are compared as rows of pairs; larger ones in blocks of about BLOCK members.
PAIRED, BLOCK = 24, 2000
#: Groups up to this size are rid of members without an admissible partner before they are written.
PRUNED = 64
#: Rows of a group that a task holds; of a larger group it keeps the hub alone.
HELD_ROWS = 20_000
#: Rows of entries in an Arrow batch: they are narrow, and a batch costs as much as thousands of them. Batches of texts are bounded by their bytes.
ENTRY_ROWS = 20_000
#: Partners of a home in one part of it.
PART = 2000
#: The bit of `info` that says that the key has members in other slots.
SLOTTED = np.int64(-(1 << 63))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's edges, each named by its smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "comp"])


_NAMES = ["key", "slot", "node", "info", "hub", "hub_info"]


def shared_keys(near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Callable:
    """A task for rows (key, slot, node, info) sorted by slot: it gives those of slots with several nodes, each once, and the slot's hub. A null key is the slot.

    near(info, info) says of which rows the filter of candidates admits the pair: members of small groups without any such
    partner go, unless their key has other slots. A group may have any size: of one that is larger than HELD_ROWS only
    the hub is held.
    """

    def groups(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.flatnonzero(np.diff(slot, prepend=slot[0] ^ np.int64(1)) != 0)
        return fresh, np.diff(np.append(fresh, len(slot)))

    def whole(rows: list[np.ndarray]) -> list[np.ndarray]:
        """Rows of groups that are complete."""
        order = np.lexsort((rows[3], rows[2], rows[1]))  # the bit SLOTTED first
        key, slot, node, info = (x[order] for x in rows)
        again = np.zeros(len(key), bool)
        again[1:] = (slot[1:] == slot[:-1]) & (node[1:] == node[:-1])
        if again.any():
            key, slot, node, info = (x[~again] for x in (key, slot, node, info))
        first, size = groups(slot)
        apart = slot != key
        keep = np.repeat(size > 1, size) | apart
        key, slot, node, info = (x[keep] for x in (key, slot, node, info))
        if not len(key):
            return [key] * 6
        if near:
            first, size = groups(slot)
            marked = np.maximum.reduceat(((info < 0) | (slot != key)).astype(np.int8), first) > 0
            ok = np.repeat(marked | (size > PRUNED), size)
            info = info & ~SLOTTED
            small = np.flatnonzero(~ok)
            for d in range(1, PRUNED):
                small = small[small + d < len(slot)]
                small = small[slot[small] == slot[small + d]]
                if not len(small):
                    break
                hit = small[near(info[small], info[small + d])]
                ok[hit] = True
                ok[hit + d] = True
            key, slot, node, info = (x[ok] for x in (key, slot, node, info))
            if not len(key):
                return [key] * 6
        first, size = groups(slot)
        return [key, slot, node, info, np.repeat(node[first], size), np.repeat(info[first], size)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        large: tuple[int, int, int] | None = None  # slot, hub and the hub's info of a large group that may go on

        def given(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=_NAMES)

        for b in batches:
            slot = b.column(1).to_numpy()
            key = b.column(0)
            key = np.where(key.is_null().to_numpy(zero_copy_only=False), slot, key.fill_null(0).to_numpy()) if key.null_count else key.to_numpy()
            rows = [np.concatenate([x, y]) for x, y in zip(held, (key, slot, b.column(2).to_numpy(), b.column(3).to_numpy()), strict=True)]
            if not len(rows[0]):
                continue
            if large:
                end = int(np.searchsorted(rows[1] != large[0], True)) if (rows[1] != large[0]).any() else len(rows[1])
                if end:
                    part = [x[:end] for x in rows]
                    yield from given([*part[:3], part[3] & ~SLOTTED, np.full(end, large[1]), np.full(end, large[2])])
                    rows = [x[end:] for x in rows]
                    held = rows
                    if not len(rows[0]):
                        continue
                large = None
            last = len(rows[1]) - int(np.searchsorted(rows[1][::-1] != rows[1][-1], True)) if (rows[1] != rows[1][-1]).any() else 0
            held = [x[last:] for x in rows]
            if last:
                yield from given(whole([x[:last] for x in rows]))
            if len(held[0]) > HELD_ROWS:
                large = (int(held[1][0]), int(held[2][0]), int(held[3][0] & ~SLOTTED))
                yield from given([*held[:3], held[3] & ~SLOTTED, np.full(len(held[0]), large[1]), np.full(len(held[0]), large[2])])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from given(whole(held))

    return lean(task)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the undirected `edges` (a, b); comp is the smallest node of its component.

    A counted small number of edges is one task's. Else distributed union-find by contraction: each node points to the smallest of its neighbourhood, edges are rewritten
    between what is pointed to, and pointers are composed, until no edge is left. Each round is a written table, so a
    lost executor repeats one round at most. Rows of a node with many edges are combined before the shuffle.
    """
    if edges.limit(TASK_EDGES + 1).count() <= TASK_EDGES:
        return stash(edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(lean(_union_find), "node bigint, comp bigint"))
    rest = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    comp = None
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        up = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up")))
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = stash(rest.join(a, "a").join(b, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        if comp is None:
            comp = up.select("node", F.col("up").alias("comp"))
        else:
            step = up.select(F.col("node").alias("comp"), "up")
            comp = stash(comp.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        discard(rest)
        rest = left
    return edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0) if comp is None else comp


def compare(pairs: DataFrame, content: Callable[[DataFrame], DataFrame], linked_to: Callable[[object], Callable[[object], bool]]) -> DataFrame:
    """The pairs (a, b) that are links, as a written table; each is looked at once.

    content(nodes) gives (node, load) of a table of nodes; linked_to(load) prepares one side and returns a test of the other.
    Of a pair the node with more partners is the home. Each load goes once to each home of its node, and the home's own
    goes there too, so a group of n copies moves n loads. A home with many partners has parts.
    """
    spark = pairs.sparkSession
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    degree = stash(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")))
    a, b = (bounded(degree.select(F.col("node").alias(s), F.col("degree").alias(f"d{s}"))) for s in "ab")
    at_a = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    homes = pairs.join(a, "a").join(b, "b").select(F.when(at_a, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(at_a, F.col("a")).otherwise(F.col("b")).alias("home"), F.greatest("da", "db").alias("d"))
    homes = stash(homes.select("node", "home", F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / PART)).alias("part")))
    roles = homes.select("node", "home", "part").union(homes.select(F.col("home").alias("node"), "home", "part").distinct())
    nodes = degree.select("node")
    rows = content(nodes).join(bounded(stash(roles)), "node").select("home", "part", (F.col("node") != F.col("home")).alias("other"), "node", "load")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = test = None
        for batch in batches:
            out: list[list[int]] = [[], []]
            home, part, other, node = (batch.column(k).to_pylist() for k in range(4))
            loads = batch.column(4)
            for k in range(len(batch)):
                if (home[k], part[k]) != now:
                    now, test = (home[k], part[k]), linked_to(loads[k].as_py())
                elif other[k] and test(loads[k].as_py()):
                    out[0].append(min(home[k], node[k]))
                    out[1].append(max(home[k], node[k]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    arrow_rows(spark, 200)
    links = stash(rows.repartition("home", "part").sortWithinPartitions("home", "part", "other", "node").mapInArrow(lean(task), "a bigint, b bigint"))
    arrow_rows(spark)
    discard(degree, homes)
    tidy(spark)
    return links


def _cells(rows: DataFrame) -> DataFrame:
    """Large groups in blocks of about BLOCK rows, and each row in the cells of its block with every block of its group: a group of n rows gives n * n / BLOCK."""
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("node", F.lit(-1)), blocks)
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    cell = F.least("own", "other") * (1 << 20) + F.greatest("own", "other")
    return rows.select("key", cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "info", "comp")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(entries: DataFrame, admits: Callable[[Column, Column], Column], near: Callable[[np.ndarray, np.ndarray], np.ndarray], verify: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], None] | None = None, inside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, comp) of the nodes that have a link.

    entries: key, slot, node and info, all long. A slot is a part of a key's group: the key itself where the group has one
    slot, and then the key may be null. Of a key with several, rows whose slot is the key have the bit SLOTTED in their info, one at least in each slot that
    is the key. admits(info, info) is a lossless filter of candidates, near the same in numpy; verify(pairs a, b) returns the
    pairs that are links, exactly, as a written table. prepare(node) is called once, before, with all nodes that may be in
    a pair. inside(key, cell, side, node, info, comp), where given, finds links between components in large groups, whose
    candidates are then never rows: a cell holds two blocks of a group (sides 0 and 1), or one (side 0).
    """
    spark = entries.sparkSession
    order = F.struct(F.xxhash64("node").alias("h"), "node", "info")
    rows = entries.repartition("slot").sortWithinPartitions("slot").select("key", "slot", "node", "info")
    arrow_rows(spark, ENTRY_ROWS)
    common = stash(rows.mapInArrow(shared_keys(near), ", ".join(f"`{c}` bigint" for c in _NAMES)))
    arrow_rows(spark)
    del rows
    tidy(spark)  # the shuffle of all entries is the largest; what is left of it has been written
    if prepare:
        prepare(common.select("node").distinct())

    first = common.where("node <> hub").where(admits(F.col("info"), F.col("hub_info"))).groupBy("node", "hub").agg(F.count("*").alias("n"))
    hubs = common.where("slot <> key").select("key", F.col("hub").alias("node"), F.col("hub_info").alias("info")).distinct()
    top = hubs.groupBy("key").agg(F.min(order).alias("top"))
    others = hubs.join(top, "key").where("node <> top.node").where(admits(F.col("info"), F.col("top.info"))).select("node", F.col("top.node").alias("hub")).distinct()
    first = stash(first.union(others.withColumn("n", F.lit(0).cast("long"))))
    # the hub that shares most keys with a node is likeliest to be linked with it
    one = first.groupBy("node").agg(F.max_by("hub", F.struct("n", F.xxhash64("hub"))).alias("hub"))
    tried = stash(one.select(*_pair(F.col("node"), F.col("hub"))).distinct())
    edges = verify(tried)
    comp = components(edges)

    def attempt(pairs: DataFrame) -> None:
        """Verifies the pairs that haven't been verified."""
        nonlocal tried, edges, comp
        fresh = stash(pairs.distinct().join(bounded(tried), ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            more = verify(fresh)
            if not more.isEmpty():
                edges = edges.union(more)
                comp = components(edges)
            tried = tried.union(fresh)
        tidy(spark)

    x, y = bounded(comp.select("node", F.col("comp").alias("cx"))), bounded(comp.select(F.col("node").alias("hub"), F.col("comp").alias("cy")))
    attempt(first.join(x, "node", "left").join(y, "hub", "left").where(F.coalesce("cx", "node") != F.coalesce("cy", "hub")).select(*_pair(F.col("node"), F.col("hub"))))

    for turn in range(1, HUB_ROUNDS + 1):
        last = turn == HUB_ROUNDS
        now = common.select("key", "node", "info").join(bounded(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = stash(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "info", "comp")).alias("hub")).where("lo <> hi").select("key", "size", "hub"))
        if last:  # every candidate in different components
            now = stash(now.join(bounded(mixed.select("key", "size")), "key").distinct())
            if inside:
                more = inside(_cells(now.where(F.col("size") > PAIRED)))
                if not more.isEmpty():
                    edges = edges.union(more)
                    comp = components(edges)
                now = now.where(F.col("size") <= PAIRED)
            x, y = (now.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "info", "comp")]) for s in "xy")
            pairs = x.join(y, "key").where("node_x < node_y and comp_x <> comp_y").where(admits(F.col("info_x"), F.col("info_y"))).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
        else:
            pairs = now.join(bounded(mixed.select("key", "hub")), "key").where("node <> hub.node and comp <> hub.comp").where(admits(F.col("info"), F.col("hub.info"))).select(*_pair(F.col("node"), F.col("hub.node")))
        attempt(pairs)
    discard(common)
    return comp
