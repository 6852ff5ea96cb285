"""A prefix trie of conversations, measured by the Euler-tour technique.

Every node has an enter and an exit arc; the arcs form one list, the tour. The list is ranked: chains within blocks of
arcs are contracted first, then random mates are spliced out until few are left. Leaves and savings of a subtree are
differences of prefix sums at the ranks of a node's two arcs.

All orders (turns of a conversation, turns of a rebuilt one, nodes, children of a node) are range-sorted over the whole
table, so a conversation, node or group of copies of any size is spread over as many tasks as its rows need. What a task
must know of the one before it (a number, a hash, a parent) is a row for each task and is all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

SHARED, KIN = 9, 5  # a shared beginning has fewer than SHARED turns; KIN neighbouring conversations share one
MODULUS, BASE = (1 << 127) - 1, 0x5DEECE66D1B54A32D192ED03A3C59AC3
ROOT = bytes(16)
BLOCK = 1 << 16
IDS_TOGETHER = 4096


def sorted_blocks(df: DataFrame, keys: list[str], run, schema: str, name: str) -> DataFrame:
    """What run makes of each task's rows, which are sorted by keys over the whole table; block numbers the tasks in that order."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for out in run(batches):
            yield out.append_column("block", pa.array(np.full(out.num_rows, block, np.int32)))

    return saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(numbered, schema + ", block int"), name)


def run_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch and its rows' numbers, from 1, within stretches of equal first columns."""
    last, count = None, 0
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
            n = np.arange(1, len(ids) + 1) - np.repeat(starts[:-1], np.diff(starts))
            if ids[0] == last:
                n[: starts[1]] += count
            last, count = ids[-1], n[-1]
            yield batch, n


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % SHARED


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, mark, size): each turn's place in its conversation, a hash of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role), F.concat(role, text)), 256)), 1, 16)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n in run_numbers(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(3), batch.column(4)], ["conv_id", "n", "mark", "size"])

    local = sorted_blocks(turns, ["conv_id", "turn", "role", "mark", "row"], run, "conv_id long, n long, mark binary, size long", "turns")
    ends = local.groupBy("block").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n")).alias("last")).orderBy("block").collect()
    carried, before = [], (None, 0)
    for r in ends:
        carried.append((r.block, *before))
        before = (r.last.conv_id, r.last.n + (before[1] if r.first == r.last.conv_id == before[0] else 0))
    known = local.sparkSession.createDataFrame(carried, "block int, conv long, before long")
    n = F.col("n") + F.when(F.col("conv") == F.col("conv_id"), F.col("before")).otherwise(0)
    return local.join(F.broadcast(known), "block").select("conv_id", n.alias("pos"), "mark", "size")


def rebuilt_turns(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, pos, mark, size): the first turns come from the first of the kin, the others are a conversation's own. pos only orders."""
    own = turns.where(F.col("pos") > shared_turns(F.col("conv_id")))
    around = F.expr(f"sequence(greatest(base, {-(1 << 63) + KIN}) - {KIN - 1}, least(base, {(1 << 63) - KIN}) + {KIN - 1})")
    first = turns.where((F.col("conv_id") % KIN == 0) & (F.col("pos") < SHARED)).withColumnRenamed("conv_id", "base")
    first = first.select(F.explode(around).alias("conv_id"), "base", "pos", "mark", "size").where((F.col("conv_id") - F.col("conv_id") % KIN == F.col("base")) & (F.col("pos") <= shared_turns(F.col("conv_id"))))
    return own.unionByName(first.join(ids, "conv_id", "left_semi").select("conv_id", "pos", "mark", "size"))


def paths(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, size): each turn with hashes of its conversation up to it and up to the turn before.

    A hash is a polynomial in the turns' marks modulo 2^127 - 1, so one that is taken up in the middle of a conversation
    can be completed when what came before is known. Nodes are equal up to collisions of such hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = 0
        for batch, n in run_numbers(batches):
            nodes, parents = [], []
            for k, mark in zip(n.tolist(), batch.column(2).to_pylist(), strict=True):
                before = value if k > 1 else 0
                value = (before * BASE + int.from_bytes(mark, "big")) % MODULUS
                parents.append(before.to_bytes(16, "big"))
                nodes.append(value.to_bytes(16, "big"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column(3)], ["conv_id", "depth", "node", "parent", "size"])

    schema = "conv_id long, depth long, node binary, parent binary, size long"
    local = sorted_blocks(rebuilt, ["conv_id", "pos"], run, schema, "paths")
    ends = local.groupBy("block").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "node")).alias("last")).orderBy("block").collect()
    carried, before = {}, (None, 0, 0)
    for r in ends:
        carried[r.block] = before
        n, value = r.last.depth, int.from_bytes(r.last.node, "big")
        if r.first == r.last.conv_id == before[0]:
            n, value = n + before[1], (before[2] * pow(BASE, n, MODULUS) + value) % MODULUS
        before = (r.last.conv_id, n, value)
    open_ = {block: c for block, c in carried.items() if c[0] is not None}

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([0, 1, 2, 3, 4])
            block = batch.column(5).to_numpy()
            here = np.isin(block, list(open_)) if open_ else np.zeros(len(block), bool)
            here[here] = batch.column(0).to_numpy()[here] == [open_[b][0] for b in block[here].tolist()]
            if here.any():
                depth, nodes, parents = rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()
                for k in np.flatnonzero(here).tolist():
                    _, n, value = open_[int(block[k])]
                    for part, exponent in ((nodes, depth[k]), (parents, depth[k] - 1)):
                        part[k] = ((value * pow(BASE, exponent, MODULUS) + int.from_bytes(part[k], "big")) % MODULUS).to_bytes(16, "big")
                    depth[k] += n
                rows = pa.RecordBatch.from_arrays([rows.column(0), pa.array(depth, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), rows.column(4)], rows.schema.names)
            yield rows

    return local.mapInArrow(complete, schema)


def numbered_nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(k, node, parent, depth, conv_id, n_convs, size) of each node, numbered from the root, k = 0, by conv_id and depth."""
    inner = turns.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("n", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    local = sorted_blocks(root.unionByName(inner), ["conv_id", "depth"], run, "node binary, parent binary, depth long, conv_id long, n_convs long, size long, n long", "nodes")
    sizes = local.groupBy("block").count().orderBy("block").collect()
    starts = np.cumsum([0] + [r["count"] for r in sizes]).tolist()
    known = local.sparkSession.createDataFrame([(r.block, start) for r, start in zip(sizes, starts, strict=False)], "block int, start long")
    return local.join(F.broadcast(known), "block").select((F.col("start") + F.col("n")).alias("k"), "node", "parent", "depth", "conv_id", "n_convs", "size")


def families(nodes: DataFrame) -> DataFrame:
    """For each node a row of kind 0 with its first child as `following`, and for each but the root one of kind 1 with its parent and next sibling.

    The rows are sorted by the parent's hash, the parent itself first and its children after it by conv_id: the row after a
    row is the first child or the next sibling, the last row of kind 0 before it is the parent.
    """
    gain = ((F.col("n_convs") - 1) * F.col("size")).alias("gain")
    rows = nodes.select(F.col("node").alias("key"), F.lit(0).alias("kind"), "conv_id", "k", gain)
    rows = rows.unionByName(nodes.where("depth > 0").select(F.col("parent").alias("key"), F.lit(1).alias("kind"), "conv_id", "k", gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, above_conv, waiting, first = None, None, None, True
        names = ["kind", "k", "gain", "above", "above_conv", "following", "first", "last"]
        kinds = [pa.int32(), *[pa.int64()] * 5, pa.bool_(), pa.bool_()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            done = []
            for kind, conv, k, g in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
                if waiting:
                    done.append((*waiting[:5], k if kind else -1, waiting[5], False))
                if not kind:
                    above, above_conv = k, conv
                waiting = (kind, k, g, above, above_conv, first)
                first = False
            if done:
                yield out(done)
        if waiting:
            yield out([(*waiting[:5], None, waiting[5], True)])

    schema = "kind int, k long, gain long, above long, above_conv long, following long, first boolean, last boolean"
    local = sorted_blocks(rows, ["key", "kind", "conv_id"], run, schema, "families")
    edges: dict[int, dict] = {}
    for r in local.where("first or last").select("block", "kind", "k", "above", "above_conv", "first", "last").collect():
        edges.setdefault(r.block, {}).update({"head": r} if r["first"] else {}, **({"tail": r} if r["last"] else {}))
    carried, above = [], (None, None)
    blocks = sorted(edges)
    for block, after in zip(blocks, [*blocks, None][1:], strict=True):
        head = edges[after]["head"] if after is not None else None
        carried.append((block, *above, head.k if head and head.kind else -1))
        tail = edges[block]["tail"]
        above = (tail.above, tail.above_conv) if tail.above is not None else above
    known = local.sparkSession.createDataFrame(carried, "block int, open_above long, open_conv long, next long")
    known = local.join(F.broadcast(known), "block")
    return known.select("kind", "k", "gain", F.coalesce("above", "open_above").alias("above"), F.coalesce("above_conv", "open_conv").alias("above_conv"), F.coalesce("following", "next").alias("following"))


def tour(kin: DataFrame) -> DataFrame:
    """(arc, to, leaf, gain): the list of arcs, 2k entering node k and 2k + 1 leaving it; the root's exit leads to -1."""
    follows = F.col("following") >= 0
    enter = kin.where("kind = 0").select((2 * F.col("k")).alias("arc"), F.when(follows, 2 * F.col("following")).otherwise(2 * F.col("k") + 1).alias("to"), F.when(follows, 0).otherwise(1).cast("long").alias("leaf"), "gain")
    none = F.lit(0).cast("long")
    leave = kin.where("kind = 1").select((2 * F.col("k") + 1).alias("arc"), F.when(follows, 2 * F.col("following")).otherwise(2 * F.col("above") + 1).alias("to"), none.alias("leaf"), none.alias("gain"))
    end = kin.where("kind = 0 and k = 0").select(F.lit(1).cast("long").alias("arc"), F.lit(-1).cast("long").alias("to"), none.alias("leaf"), none.alias("gain"))
    return enter.unionByName(leave).unionByName(end)


def contracted(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """arcs with the head of each one's chain within its block of numbers, its offset there, and for heads the next head and the chain's length."""

    def run(t: pa.Table) -> pa.Table:
        ids, to = t["arc"].to_numpy(), t["to"].to_numpy()
        order = np.argsort(ids)
        place = np.searchsorted(ids, to, sorter=order)
        place = order[np.minimum(place, len(ids) - 1)]
        inside = ids[place] == to
        is_head = np.ones(len(ids), bool)
        is_head[place[inside]] = False
        following = np.where(inside, place, -1).tolist()
        head, offset = [0] * len(ids), [0] * len(ids)
        leads, length = [None] * len(ids), [None] * len(ids)
        for h in np.flatnonzero(is_head).tolist():
            at, n = h, 0
            while at >= 0:
                head[at], offset[at], last, at = h, n, at, following[at]
                n += 1
            leads[h], length[h] = int(to[last]), n
        out = [("head", pa.array(ids[head], pa.int64())), ("offset", pa.array(offset, pa.int64())), ("leads", pa.array(leads, pa.int64())), ("length", pa.array(length, pa.int64()))]
        for name, column in out:
            t = t.append_column(name, column)
        return t.select(["arc", "leaf", "gain", *(name for name, _ in out)])

    keyed = arcs.withColumn("block", F.floor(F.col("arc") / block).cast("long"))
    return saved(keyed.groupBy("block").applyInArrow(run, "arc long, leaf long, gain long, head long, offset long, leads long, length long"), "chains")


def list_ranks(items: DataFrame, few: int = BLOCK) -> DataFrame:
    """(item, rank) for a list of (item, to, weight) that ends in -1: the weights before each item.

    While more than few are left, about a quarter goes: each item tosses a coin, and one with heads that follows one with
    tails is spliced out. The last few are ranked by one task, and those spliced out get their ranks back in reverse.
    """
    gone, turn = [], 0
    items = saved(items.select("item", "to", "weight"), "items")
    while items.count() > few:
        heads = F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(2)) == 1
        tails = items.where(~heads).withColumn("key", F.col("to"))
        mates = items.where(heads).select(F.col("item").alias("key"), F.col("item").alias("mate"), F.col("to").alias("mate_to"), F.col("weight").alias("mate_weight"))
        met = saved(tails.join(mates, "key", "full_outer").drop("key"), "mates")
        gone.append(met.where("item is not null and mate is not null").select(F.col("mate").alias("item"), F.col("item").alias("before"), F.col("weight").alias("after")))
        paired = F.col("item").isNotNull() & F.col("mate").isNotNull()
        items = saved(met.select(F.coalesce("item", "mate").alias("item"), F.when(paired | F.col("item").isNull(), F.col("mate_to")).otherwise(F.col("to")).alias("to"), (F.coalesce("weight", F.lit(0)) + F.coalesce("mate_weight", F.lit(0))).alias("weight")), "items")
        turn += 1

    def run(t: pa.Table) -> pa.Table:
        to = dict(zip(t["item"].to_pylist(), zip(t["to"].to_pylist(), t["weight"].to_pylist(), strict=True), strict=True))
        at, rank, ranks = next(iter(to.keys() - {x for x, _ in to.values()})), 0, {}
        while at >= 0:
            ranks[at] = rank
            at, weight = to[at]
            rank += weight
        return pa.table({"item": pa.array(ranks.keys(), pa.int64()), "rank": pa.array(ranks.values(), pa.int64())})

    ranks = saved(items.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "item long, rank long"), "ranks")
    for pairs in reversed(gone):
        back = pairs.join(ranks.withColumnRenamed("item", "before"), "before").select("item", (F.col("rank") + F.col("after")).alias("rank"))
        ranks = saved(ranks.unionByName(back), "ranks")
    return ranks


def subtree_sums(chains: DataFrame, ranks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k, n_leaves, saved_tokens): leaves and gains between the two arcs of each node, from prefix sums along the tour."""
    placed = chains.join(ranks, F.col("head") == F.col("item")).select("arc", "leaf", "gain", (F.col("rank") + F.col("offset")).alias("rank"))
    placed = placed.withColumn("block", F.floor(F.col("rank") / block).cast("long"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        for name in ("leaf", "gain"):
            t = t.append_column(f"{name}_sum", pa.array(np.cumsum(t[name].to_numpy())))
        return t.select(["arc", "leaf", "gain", "block", "leaf_sum", "gain_sum"])

    local = saved(placed.groupBy("block").applyInArrow(run, "arc long, leaf long, gain long, block long, leaf_sum long, gain_sum long"), "sums")
    totals = local.groupBy("block").agg(F.sum("leaf").alias("leaves"), F.sum("gain").alias("gains"))
    before = "sum({}) over (order by block rows between unbounded preceding and 1 preceding)"  # a row for each 65,536 arcs
    totals = totals.select("block", F.coalesce(F.expr(before.format("leaves")), F.lit(0)).alias("leaves"), F.coalesce(F.expr(before.format("gains")), F.lit(0)).alias("gains"))
    at = local.join(totals, "block").select(F.shiftright("arc", 1).alias("k"), "leaf", "gain", (F.col("leaf_sum") + F.col("leaves")).alias("leaves"), (F.col("gain_sum") + F.col("gains")).alias("gains"))
    between = lambda sums, own: F.max(sums) - F.min(sums) + F.sum(own)
    return at.groupBy("k").agg(between("leaves", "leaf").alias("n_leaves"), between("gains", "gain").alias("saved_tokens"))


def end_hashes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the conversations that end at a node.

    A hash has to be taken in order: the ids are sorted over the whole table and joined up, some thousand to a row, before
    the rows of a node are read one after another by one task, which holds one row.
    """
    last = turns.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("node", F.lit(ROOT)).alias("node"), "conv_id")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, convs, rows, first = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            for k in range(1, len(nodes) + 1):
                if k == len(nodes) or nodes[k] != nodes[first] or k - first == IDS_TOGETHER:
                    rows.append((nodes[first], convs[first], ",".join(map(str, convs[first:k]))))
                    first = k
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], ["node", "ends_sha256"])

        for batch in batches:
            done = []
            for node, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node == now:
                    sha.update(b",")
                else:
                    if sha:
                        done.append((now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                sha.update(part.encode())
            if done:
                yield out(done)
        if sha:
            yield out([(now, sha.hexdigest())])

    joined = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join_up, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie.

    Turns are ordered by turn, nulls first, equal ones by role and a hash of role and text; repeated rows are turns of their
    own. Null roles and texts are empty. Rows without conv_id belong to no conversation and are ignored, as are other
    columns. A table without conversations has no node, not even the root.
    """
    turns = numbered_turns(conversations.select("conv_id", "turn", "role", "text"))
    ids = saved(turns.select("conv_id").distinct(), "ids")
    rebuilt = paths(rebuilt_turns(turns, ids))
    nodes = numbered_nodes(rebuilt, ids)
    kin = families(nodes)
    chains = contracted(tour(kin), block)
    heads = chains.where("length is not null").select(F.col("head").alias("item"), F.col("leads").alias("to"), F.col("length").alias("weight"))
    sums = subtree_sums(chains, list_ranks(heads, block), block)
    parents = kin.where("kind = 1").select("k", F.col("above_conv").alias("parent_conv_id"))
    children = kin.where("kind = 1").groupBy(F.col("above").alias("k")).agg(F.count("*").alias("n_children"))
    out = nodes.join(sums, "k").join(parents, "k", "left").join(children, "k", "left").join(end_hashes(rebuilt, ids), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
