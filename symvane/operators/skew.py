"""Per-key results and joins where a few keys hold most rows.

Fragment and replicate by estimated load. A first pass counts rows per hash bucket of the
key (a fixed number of buckets, combined before the shuffle); keys in overfull buckets are
counted exactly. Buckets of light keys and shards of heavy keys are then bin-packed onto
tasks, largest first. Rows of a heavy key go to one of its shards by a hash of other
columns, so a retried task places them alike; the other side of a join is copied to the
shards of heavy keys only.

Everything the driver gathers is bounded by constants: `BUCKETS` counts and at most
`SPLIT * tasks` heavy keys. No row is dropped, capped or sampled.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symvane.runtime import fresh, tasks_of

#: Hash buckets that light keys are packed by.
BUCKETS = 4096
#: A key is heavy when it holds more rows than an even task's share divided by this.
SPLIT = 4


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF


def murmur3_int(value: int, seed: int = 42) -> int:
    """Spark's hash of one int column (Murmur3, 32 bit, signed)."""
    k = _rotl((value * 0xCC9E2D51) & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (_rotl(seed ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 4
    for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * mul) & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def slots(tasks: int) -> list[int]:
    """For each task an int that hash-partitioning over `tasks` partitions sends to it."""
    out, found, value = [0] * tasks, set(), 0
    while len(found) < tasks:
        at = murmur3_int(value) % tasks
        if at not in found:
            found.add(at)
            out[at] = value
        value += 1
    return out


def pack(loads: list[int], tasks: int) -> list[int]:
    """The task of each item: largest load first, always onto the emptiest task."""
    heap = [(0, t) for t in range(tasks)]
    out = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, t = heapq.heappop(heap)
        out[i] = t
        heapq.heappush(heap, (load + loads[i], t))
    return out


@dataclass
class Plan:
    """Where rows go. `heavy`: (key values, rows, slots of its shards)."""

    keys: list[str]
    tasks: int
    total: int
    bucket_slots: list[int]
    heavy: list[tuple[tuple, int, list[int]]]
    key_types: list[T.DataType]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(BUCKETS)).cast("int")

    def _light_slot(self) -> Column:
        packed = F.split(F.lit(",".join(map(str, self.bucket_slots))), ",").cast("array<int>")
        return F.element_at(packed, self._bucket() + 1)

    def heavy_frame(self, df: DataFrame, names: list[str], slots_as: str) -> DataFrame:
        schema = T.StructType([T.StructField(n, t) for n, t in zip(names, self.key_types)] + [T.StructField(slots_as, T.ArrayType(T.IntegerType()))])
        return df.sparkSession.createDataFrame([(*key, s) for key, _, s in self.heavy], schema)

    def _with_shards(self, df: DataFrame, shards: str) -> DataFrame:
        if not self.heavy:
            return df.withColumn(shards, F.lit(None).cast("array<int>"))
        names = fresh(df, *[f"__heavy_{i}" for i in range(len(self.keys))])
        heavy = self.heavy_frame(df, names, shards)  # at most SPLIT * tasks rows
        same = [df[k].eqNullSafe(heavy[n]) for k, n in zip(self.keys, names)]
        return df.join(F.broadcast(heavy), same, "left").drop(*names)

    def place(self, df: DataFrame, slot: str, salt: list[Column]) -> DataFrame:
        """df with the slot of each row; rows of a heavy key are spread by a hash of `salt`."""
        (shards,) = fresh(df, "__shards")
        pick = F.element_at(shards, (F.pmod(F.xxhash64(*salt), F.size(shards)) + 1).cast("int"))
        return self._with_shards(df, shards).withColumn(slot, F.when(F.col(shards).isNotNull(), pick).otherwise(self._light_slot())).drop(shards)

    def replicate(self, df: DataFrame, slot: str) -> DataFrame:
        """df with each row once per shard of its key, that is once where the key is light."""
        (shards,) = fresh(df, "__shards")
        all_slots = F.coalesce(F.array_distinct(shards), F.array(self._light_slot()))
        return self._with_shards(df, shards).withColumn(slot, F.explode(all_slots)).drop(shards)


def plan_loads(df: DataFrame, keys: list[str], tasks: int | None = None, task_rows: int | None = None) -> Plan:
    """Measure the loads of df's keys and pack them onto tasks; with `task_rows` onto more tasks where they would get more rows.

    Null is a key like any other. An empty df gives a plan without heavy keys.
    """
    tasks = tasks or tasks_of(df.sparkSession)
    only = df.select(*keys)
    types = [only.schema[k].dataType for k in keys]
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS)).cast("int")
    loads = [0] * BUCKETS
    for b, n in only.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        loads[b] = n
    total = sum(loads)
    if task_rows:
        tasks = max(tasks, -(-total // task_rows))
    limit = max(1, total // (SPLIT * tasks))
    full = [b for b, n in enumerate(loads) if n > limit]
    heavy_rows: list[tuple[tuple, int]] = []
    if full:
        counted = only.filter(bucket.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
        rows = counted.select(*keys, "__n", bucket.alias("__b")).collect()  # at most SPLIT * tasks
        heavy_rows = sorted(((tuple(r[:-2]), r[-2]) for r in rows), key=lambda x: (-x[1], str(x[0])))
        for r in rows:
            loads[r[-1]] -= r[-2]
    shard_counts = [-(-n // limit) for _, n in heavy_rows]
    items = loads + [n // k for (_, n), k in zip(heavy_rows, shard_counts) for _ in range(k)]
    at, slot_of, heavy, i = pack(items, tasks), slots(tasks), [], BUCKETS
    for (key, n), k in zip(heavy_rows, shard_counts):
        heavy.append((key, n, [slot_of[t] for t in at[i : i + k]]))
        i += k
    return Plan(list(keys), tasks, total, [slot_of[t] for t in at[:BUCKETS]], heavy, types)


def balanced_distinct_count(df: DataFrame, keys: list[str], unique: str, plan: Plan | None = None, as_col: str = "n") -> DataFrame:
    """Distinct non-null values of `unique` per key, evenly spread: keys and their number (BIGINT) as `as_col`.

    All rows of one (key, unique) pair share a shard, so shards add up exactly. A null key is a
    group of its own; a group whose `unique` is always null counts 0; an empty df gives no rows.
    """
    slim = df.select(*keys, unique)
    plan = plan or plan_loads(slim, keys)
    slot, n = fresh(slim, "__slot", "__n")
    placed = plan.place(slim, slot, [F.col(unique)]).repartition(plan.tasks, slot)
    shard = placed.groupBy(slot, *keys, unique).agg(F.lit(1).alias("__one")).groupBy(slot, *keys).agg(F.count(unique).alias(n))
    return shard.groupBy(*keys).agg(F.sum(n).alias(as_col))


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], salt: list[str], how: str = "inner", plan: Plan | None = None) -> DataFrame:
    """Join on equal `keys` with left's heavy keys split over tasks and right's rows copied to their shards.

    `how` is inner, left, left_semi or left_anti (a row of left stays in one place, so each result row comes
    out once). Null keys match nothing. Columns of right that left also has, besides the keys, get the suffix
    `_right`. `salt` names columns of left that tell its rows apart.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"balanced_join can't be {how}")
    plan = plan or plan_loads(left, keys)
    clash = {c.lower() for c in left.columns} - {k.lower() for k in keys}
    right = right.select([F.col(c).alias(f"{c}_right") if c.lower() in clash else F.col(c) for c in right.columns])
    (slot,) = fresh(left.select("*"), "__slot")
    while slot in right.columns:
        slot = f"_{slot}"
    return plan.place(left, slot, [F.col(c) for c in salt]).join(plan.replicate(right, slot), [slot, *keys], how).drop(slot)


def heavy_keys(counts: DataFrame, total: int, share: float) -> DataFrame:
    """Rows of `counts` whose n is at least `share` of total."""
    return counts.filter((F.col("n") >= F.lit(share) * F.lit(total)) & (F.col("n") > 0))
