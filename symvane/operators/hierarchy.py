"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles.

Links are first combined inside each partition by a weighted disjoint-set forest: every node
learns its local root and its offset (number of links) below it, by path compression over
index arrays. Partitions follow a locality column (say the file), bin-packed by load with hot
values split, so nearly all links end there. The parents that lie outside a child's partition
form a much smaller forest of weighted links, one node each however many children they have. It
is merged level by level: partitions are put together `FAN` at a time, the same forest runs in
each, and only the links that others still point to from outside go up, until what is left fits
one task. Where coarser partitions hold too much for a task, or chains are so long that their
paths would, links are closed by distributed pointer doubling instead, which takes a logarithmic
number of rounds and finds cycles exactly; open links alone take part in it. Paths are then laid
out by walking the indexed parents, local part after the part above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symvane.operators.skew import balanced_join, plan_loads
from symvane.runtime import MERGE_ROWS, cut, tasks_of

#: Most links of the upper levels, and path elements they hold, that are sent to all tasks at once; beyond, the join is spread by load.
BROADCAST_LINKS, BROADCAST_ELEMENTS = 20_000, 500_000
#: Most nodes of one partition-local forest, beside as many tasks as the session plans for.
TASK_ROWS = 250_000
#: Partitions put together from one level of the merge to the next.
FAN = 8
#: Most path elements that one task of the merge makes.
MERGE_ELEMENTS = 5_000_000
#: What a chain ends in.
ROOTED, ORPHAN, CYCLE, BELOW_CYCLE, OPEN = 0, 1, 2, 3, 4
STATES = ["rooted", "orphan", "cycle", "below_cycle"]

_LOCAL = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("top", T.LongType()), T.StructField("off", T.IntegerType()),
    T.StructField("out_parent", T.LongType()), T.StructField("state", T.IntegerType()), T.StructField("cycle_min", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("home", T.IntegerType()),
])


def compress(up: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Roots of a forest given as parent positions (-1: none), with weighted offsets.

    Returns root positions, offsets, the state (ROOTED, CYCLE, BELOW_CYCLE) and, for the latter
    two, a member of the cycle that is the same for all (the smallest position).
    """
    n = len(up)
    at = np.arange(n)
    jump = np.where(up >= 0, up, at)
    off = np.where(up >= 0, weight, 0).astype(np.int64)
    least = np.minimum(at, jump)
    for _ in range(max(1, int(np.ceil(np.log2(max(n, 2)))) + 1)):
        off = off + off[jump]
        least = np.minimum(least, least[jump])
        jump = jump[jump]
        if (up[jump] < 0).all():
            break
    looped = up[jump] >= 0
    state = np.where(looped, BELOW_CYCLE, ROOTED)
    cycle = np.zeros(n, np.int64)
    if looped.any():  # after at least n steps a node stands on its cycle, and every cycle node is stood on
        state[np.unique(jump[looped])] = CYCLE
        around = least.copy()  # least position seen on n or more steps from a cycle node: the cycle's own
        cycle = np.where(looped, around[jump], 0)
    return jump, off, state, cycle


def walk(up: np.ndarray, depth: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions from the root down to each kept node, as (offsets, values) of a list array."""
    size = np.where(keep, depth + 1, 0)
    ends = np.r_[0, np.cumsum(size)]
    values = np.zeros(ends[-1], np.int64)
    rows = np.flatnonzero(keep)
    cur, write = rows.copy(), ends[rows + 1] - 1
    while len(rows):
        values[write] = cur
        more = write > ends[rows]
        rows, cur, write = rows[more], up[cur[more]], write[more] - 1
    return ends.astype(np.int32), values


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    table = table.take(pa.array(order))
    has_parent = table["parent"].is_valid().to_numpy()
    parent = table["parent"].fill_null(0).to_numpy()
    found = np.searchsorted(ids, parent)
    inside = has_parent & (found < len(ids)) & (ids[np.minimum(found, len(ids) - 1)] == parent)
    up = np.where(inside, found, -1)
    top, off, state, cycle = compress(up, np.ones(len(ids), np.int64))
    good = state == ROOTED
    outward = good & has_parent[top]
    ends, values = walk(up, off, good)
    labels = table["label"].combine_chunks()
    out = pa.table({
        "id": ids, "top": pa.array(ids[top], mask=~good), "off": pa.array(off.astype(np.int32), mask=~good),
        "out_parent": pa.array(parent[top], mask=~outward), "state": np.where(outward, OPEN, state).astype(np.int32),
        "cycle_min": pa.array(ids[cycle], mask=good),
        "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[values])),
        "labels": pa.ListArray.from_arrays(pa.array(ends), labels.take(pa.array(values))),
        "home": pa.array(np.full(len(ids), TaskContext.get().partitionId(), np.int32)),
    })
    yield from out.to_batches(max_chunksize=20_000)


_LINK = T.StructType([
    T.StructField("t", T.LongType()), T.StructField("jump", T.LongType()), T.StructField("root_id", T.LongType()),
    T.StructField("off", T.LongType()), T.StructField("state", T.IntegerType()), T.StructField("cycle_min", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("home", T.IntegerType()),
])
_ARROW_LINK = pa.schema([("t", pa.int64()), ("jump", pa.int64()), ("root_id", pa.int64()), ("off", pa.int64()), ("state", pa.int32()), ("cycle_min", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("home", pa.int32())])
_SIZE = T.StructType([T.StructField("elements", T.LongType())])


def _upward(t: np.ndarray, jump: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Where the link that each open link jumps to stands among sorted links; -1 for closed ones and jumps out of them."""
    found = np.minimum(np.searchsorted(t, jump), max(len(t) - 1, 0))
    return np.where((state == OPEN) & (t[found] == jump), found, -1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many path elements `_merge_task` would make of these links: one row a task."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).sort_by("t")
    t, jump, state, size = (table[c].fill_null(0).to_numpy() for c in ("t", "jump", "state", "size"))
    up = _upward(t, jump, state)
    top, above, ended, _ = compress(up, size[np.maximum(up, 0)])
    yield pa.RecordBatch.from_arrays([pa.array([int((size + np.where(ended == ROOTED, above, 0)).sum())], pa.int64())], names=["elements"])


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links between the local roots of a task at once; those that jump out of it stay open, from their last link inside."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).sort_by("t")
    rows = table.to_pylist()
    up = _upward(table["t"].to_numpy(), table["jump"].fill_null(0).to_numpy(), table["state"].to_numpy())
    top, off, state, cycle = compress(up, np.array([r["off"] or 0 for r in rows]))
    smallest: dict[int, int] = {}
    for i, r in enumerate(rows):
        if state[i] == CYCLE:
            smallest[cycle[i]] = min([*r["ids"], smallest.get(cycle[i], r["ids"][0])])
    done: list[dict] = [{}] * len(rows)

    def finish(i: int) -> dict:
        r, end = rows[i], rows[top[i]]
        if state[i] != ROOTED:
            return r | {"state": int(state[i]), "cycle_min": smallest[cycle[i]], "off": None, "labels": None}
        if end["state"] in (CYCLE, BELOW_CYCLE):
            return r | {"state": BELOW_CYCLE, "cycle_min": end["cycle_min"], "off": None, "ids": None, "labels": None}
        above = done[up[i]] if up[i] >= 0 else {"ids": [], "labels": [], "root_id": r["root_id"]}
        root = r["root_id"] if above["root_id"] is None else above["root_id"]
        return r | {"state": end["state"], "jump": end["jump"], "root_id": root, "off": int(off[i]) + end["off"], "ids": above["ids"] + r["ids"], "labels": above["labels"] + r["labels"]}

    for i in np.argsort(compress(up, np.ones(len(rows), np.int64))[1], kind="stable"):  # parents before children
        done[i] = finish(int(i)) if state[i] == ROOTED else {}
    out = [done[i] if state[i] == ROOTED else finish(i) for i in range(len(rows))]
    yield from pa.Table.from_pylist(out, schema=_ARROW_LINK).to_batches(max_chunksize=5_000)


def _through(links: DataFrame, far: DataFrame, tasks: int, count: int) -> DataFrame:
    """Open links carried on over the links (`far`) of the nodes they point to; offsets and path parts add up. Closed links stay."""
    ahead = far.select(F.col("t").alias("jump"), *[F.col(c).alias(f"f_{c}") for c in far.columns if c not in ("t", "home")])
    opened = links.filter(F.col("state") == OPEN)
    if count <= TASK_ROWS:  # one task would hold them, so no key can be too heavy
        both = opened.join(ahead, "jump", "left")
    else:
        both = balanced_join(opened, ahead, ["jump"], ["t"], "left", plan_loads(opened, ["jump"], tasks))
    through = F.col("f_state").isin(ROOTED, ORPHAN, OPEN)
    lost = F.col("f_state").isin(CYCLE, BELOW_CYCLE)
    moved = both.select(
        "t",
        F.when(through, F.col("f_jump")).otherwise(F.col("jump")).alias("jump"),
        F.when(through, F.coalesce("f_root_id", "root_id")).otherwise(F.col("root_id")).alias("root_id"),
        F.when(through, F.col("off") + F.col("f_off")).otherwise(F.col("off")).alias("off"),
        F.when(lost, F.lit(BELOW_CYCLE)).otherwise(F.col("f_state")).alias("state"),
        F.when(lost, F.col("f_cycle_min")).otherwise(F.col("cycle_min")).alias("cycle_min"),
        F.when(through, F.concat("f_ids", "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(through, F.concat("f_labels", "labels")).otherwise(F.col("labels")).alias("labels"),
        "home",
    )
    return links.filter(F.col("state") != OPEN).unionByName(moved)


def _loops(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Cycles among links that never close: (t, on_cycle, cycle_min), exact at any size.

    `links` has (t, jump) one link ahead, `parts` the ids each link passes. Doubling goes on until the set of
    nodes stood on stops shrinking (then it is the cycles' nodes) and the least ids seen stop falling.
    """
    step = cut(links.select("t", "jump").join(parts.select("t", F.array_min("ids").alias("least")), "t"))
    images, total = None, None
    while True:
        far = step.select(F.col("t").alias("jump"), F.col("jump").alias("f_jump"), F.col("least").alias("f_least"))
        step = cut(step.join(far, "jump").select("t", F.col("f_jump").alias("jump"), F.least("least", "f_least").alias("least")))
        stood = step.select("jump").distinct()
        now = (stood.count(), step.join(stood.withColumnRenamed("jump", "t"), "t").agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0])
        if now == (images, total):
            break
        images, total = now
    on = step.select("jump").distinct().select(F.col("jump").alias("t"), F.lit(True).alias("on_cycle"))
    ring = step.select(F.col("t").alias("jump"), F.col("least").alias("ring_least"))
    return step.join(on, "t", "left").join(ring, "jump").select("t", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), F.col("ring_least").alias("cycle_min"))


def _merge(links: DataFrame, merge_rows: int, groups: int, tasks: int) -> DataFrame:
    """All links closed: each leads to the end of its chain, or is known to lead into a cycle.

    `groups` is the number of partitions (column home) that links have been merged in so far.
    """
    total, opened = (int(x or 0) for x in links.agg(F.count("t"), F.sum((F.col("state") == OPEN).cast("int"))).first())
    if not opened:
        return links
    coarser = 1 if total <= merge_rows else max(-(-groups // FAN), -(-total // merge_rows)) if merge_rows else groups
    if coarser < groups:
        near = links.withColumn("home", F.floor(F.col("home") * coarser / groups).cast("int"))
        placed = near.coalesce(1) if coarser == 1 else near.repartition(coarser, "home")
        makes = placed.select("t", "jump", "state", F.coalesce(F.size("ids"), F.lit(0)).alias("size")).mapInArrow(_measure, _SIZE).agg(F.max("elements")).first()[0]
        if makes <= MERGE_ELEMENTS:
            merged = cut(placed.mapInArrow(_merge_task, _LINK))
            if coarser == 1:
                return merged
            asked = merged.filter(F.col("state") == OPEN).select(F.col("jump").alias("t")).distinct()
            upper = _merge(cut(merged.join(asked, "t", "left_semi")), merge_rows, coarser, tasks)
            lower = _through(merged, upper, tasks, total)
            ring = upper.filter(F.col("state") == CYCLE).select("t", F.lit(True).alias("__ring"), F.col("cycle_min").alias("__least"))  # they lie on the cycle themselves
            on_ring = F.coalesce("__ring", F.lit(False))
            return cut(lower.join(ring, "t", "left").withColumns({"state": F.when(on_ring, CYCLE).otherwise(F.col("state")), "cycle_min": F.when(on_ring, F.col("__least")).otherwise(F.col("cycle_min"))}).select(_LINK.names))
    first = links
    while opened:
        links = cut(_through(links, links, tasks, opened))
        before, opened = opened, links.filter(F.col("state") == OPEN).count()
        if opened == before:  # a chain of any length would have closed some: what is left runs into cycles
            return _close_cycles(first, links)
    return links


def _close_cycles(first: DataFrame, links: DataFrame) -> DataFrame:
    """Close links that doubling can't, from the links as they were at first."""
    ahead = first.join(links.filter(F.col("state") == OPEN).select("t"), "t", "left_semi")
    none = F.lit(None).cast("bigint")
    looped = ahead.drop("state", "cycle_min", "off", "labels").join(_loops(ahead, ahead), "t").select(
        "t", "jump", "root_id", none.alias("off"), F.when(F.col("on_cycle"), CYCLE).otherwise(BELOW_CYCLE).alias("state"), "cycle_min", "ids", F.lit(None).cast("array<string>").alias("labels"), "home")
    return cut(links.filter(F.col("state") != OPEN).select(_LINK.names).unionByName(looped))


def hierarchy(nodes: DataFrame, id_col: str, parent_col: str, label_col: str, locality: str | None = None, merge_rows: int = MERGE_ROWS, tasks: int | None = None) -> DataFrame:
    """The place of every node in its tree, one row per distinct id.

    Columns: id, state (rooted, orphan, cycle, below_cycle), root_id, depth (INT), ids and path (from the root
    down to the node: ids and labels). A chain that ends at a node whose parent is null is rooted; one that
    ends at a node whose parent doesn't exist is an orphan's, with that last node as root. On a cycle or below
    one, root_id is the cycle's smallest id and depth, ids and path are null. Of several rows of an id the
    one with the smallest (parent, label) counts, a null parent being smallest; rows without an id are left
    out; null labels stay null in paths. An empty table gives no rows. Other columns are ignored.
    """
    spark = nodes.sparkSession
    where = F.xxhash64(F.col(locality)) if locality else F.xxhash64(F.col(id_col))
    slim = nodes.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"), F.col(label_col).cast("string").alias("label"), where.alias("near"))
    once = slim.groupBy("id").agg(F.min(F.struct("parent", "label", "near")).alias("r")).select("id", "r.parent", "r.label", "r.near")
    plan = plan_loads(slim, ["near"], tasks or tasks_of(spark), TASK_ROWS)  # copies of a row count too: an estimate is enough here
    placed = plan.place(once, "slot", [F.col("id")]).repartition(plan.tasks, "slot")
    local = cut(placed.select("id", "parent", "label").mapInArrow(_local, _LOCAL))

    # The parents that lie outside their child's partition: however many children name one, it is one node of the next level.
    outer = local.filter(F.col("state") == OPEN).select(F.col("out_parent").alias("t")).distinct()
    entry = outer.join(local.withColumnRenamed("id", "t"), "t", "left")
    gone = F.col("state").isNull()
    links = cut(entry.select(
        "t",
        F.col("out_parent").alias("jump"),
        F.col("top").alias("root_id"),
        F.when(gone, F.lit(0)).otherwise(F.col("off") + 1).cast("long").alias("off"),
        F.when(gone, F.lit(ORPHAN)).when(F.col("state") == CYCLE, F.lit(BELOW_CYCLE)).otherwise(F.col("state")).alias("state"),
        "cycle_min",
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("home", F.lit(0)).alias("home"),
    ))
    merged = _merge(links, merge_rows, plan.tasks, plan.tasks)
    ring = merged.filter(F.col("state") == CYCLE).select(F.explode("ids").alias("id"), F.lit(True).alias("on_ring")).distinct()
    above = merged.select(F.col("t").alias("out_parent"), F.col("root_id").alias("up_root"), F.col("off").alias("up_off"), F.when(F.col("state") == CYCLE, BELOW_CYCLE).otherwise(F.col("state")).alias("up_state"), F.col("cycle_min").alias("up_cycle"), F.col("ids").alias("up_ids"), F.col("labels").alias("up_labels"))
    hanging = local.filter(F.col("state") == OPEN).drop("cycle_min")
    count, elements = merged.agg(F.count("t"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    if count <= BROADCAST_LINKS and elements <= BROADCAST_ELEMENTS:
        joined = hanging.join(F.broadcast(above), "out_parent")
    else:
        joined = balanced_join(hanging, above, ["out_parent"], ["id"], plan=plan_loads(hanging, ["out_parent"], plan.tasks))
    inside = local.filter(F.col("state") != OPEN).select(
        "id", "state", F.coalesce("cycle_min", "top").alias("root_id"), F.col("off").alias("depth"), F.when(F.col("state") == ROOTED, F.col("ids")).alias("ids"), F.when(F.col("state") == ROOTED, F.col("labels")).alias("path"))
    whole = F.col("up_state").isin(ROOTED, ORPHAN)
    crossing = joined.join(ring, "id", "left").select(
        "id",
        F.when(F.col("on_ring"), CYCLE).otherwise(F.col("up_state")).alias("state"),
        F.when(whole, F.coalesce("up_root", "top")).otherwise(F.col("up_cycle")).alias("root_id"),
        F.when(whole, (F.col("off") + F.col("up_off")).cast("int")).alias("depth"),
        F.when(whole, F.concat("up_ids", "ids")).alias("ids"),
        F.when(whole, F.concat("up_labels", "labels")).alias("path"),
    )
    names = F.array(*[F.lit(s) for s in STATES])
    return inside.unionByName(crossing).withColumn("state", F.element_at(names, F.col("state") + 1))


def descendants(placed: DataFrame) -> DataFrame:
    """Pairs (id, descendant_id, distance) of every node with all below it, from `hierarchy`'s rows.

    Nodes on cycles or below them have none; a leaf gives no rows.
    """
    pairs = placed.filter(F.size("ids") > 1).select(F.col("id").alias("descendant_id"), "depth", F.posexplode("ids").alias("at", "id"))
    return pairs.filter(F.col("at") < F.col("depth")).select("id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
