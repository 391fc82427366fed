"""The N best items of every group by a mergeable, bounded aggregation.

Before the shuffle every task keeps, for each group it meets, at most N items (a bounded heap held
as a sorted block), compared by score and then by unique identifier; only these are sent. After it
the blocks of a group, which lie side by side, are merged by the same rule as they stream past: of
each group at most N items are held besides the batch just read. A group of any size thus sends at
most N rows per task and flush, and none is ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a task buffers before it reduces them to N a group.
BUFFER_ROWS = 250_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _grouped(table: pa.Table, groups: list[str]) -> np.ndarray:
    """A number per row that is equal where all group columns are."""
    group = np.zeros(table.num_rows, np.int64)
    for g in groups:
        codes = _codes(table[g])
        group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)[1]
    return group


def best(table: pa.Table, groups: list[str], order: list[tuple[str, str]], unique: str, n: int) -> tuple[pa.Table, np.ndarray]:
    """At most n rows a group, best first, one row per unique identifier (its best one), and their ranks."""
    if table.num_rows == 0:
        return table, np.zeros(0, np.int32)
    group = _grouped(table, groups)
    keyed = table.append_column("__group", pa.array(group))
    at = pc.sort_indices(keyed, sort_keys=[("__group", "ascending"), *order, (unique, "ascending")]).to_numpy()
    group = group[at]
    ids = _codes(table[unique])[at]
    first = np.sort(np.unique(group * (ids.max() + 1) + ids, return_index=True)[1])
    at, group = at[first], group[first]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return table.take(pa.array(at[rank < n])), (rank[rank < n] + 1).astype(np.int32)


def top_n(df: DataFrame, groups: list[str], order: list[tuple[str, bool]], unique: str, n: int, rank: str = "rank_no") -> DataFrame:
    """Ranks 1 to n of every group.

    `order` lists (column, descending); equal rows are ordered by `unique` ascending. Rows that share a
    `unique` within a group count once, with the best of them. A row with a null or NaN in a score, or a null
    identifier, is not ranked. Null group values form a group. n < 1 or an empty df gives no rows; groups
    smaller than n give all they have. Other columns are not carried along.
    """
    scores = [c for c, _ in order]
    slim = df.select(*dict.fromkeys([*groups, *scores, unique]))
    keep = F.col(unique).isNotNull() & (F.lit(n) > 0)
    for c in scores:
        keep &= F.col(c).isNotNull()
        if isinstance(slim.schema[c].dataType, (T.FloatType, T.DoubleType)):
            keep &= ~F.isnan(c)
    slim = slim.filter(keep)
    sort_keys = [(c, "descending" if down else "ascending") for c, down in order]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                reduced = best(pa.Table.from_batches(held), groups, sort_keys, unique, n)[0]
                if reduced.num_rows > BUFFER_ROWS // 2:  # mostly small groups: hand them on
                    yield from reduced.combine_chunks().to_batches()
                    held, rows = [], 0
                else:
                    held, rows = reduced.combine_chunks().to_batches(), reduced.num_rows
        if rows:
            yield from best(pa.Table.from_batches(held), groups, sort_keys, unique, n)[0].combine_chunks().to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group: pa.Table | None = None  # what is kept of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if open_group is None else pa.concat_tables([open_group, table]).combine_chunks()
            group = _grouped(table, groups)
            last = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0  # groups lie side by side
            yield from ranked(table.slice(0, last))
            open_group = best(table.slice(last), groups, sort_keys, unique, n)[0]
        if open_group is not None:
            yield from ranked(open_group)

    def ranked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kept, ranks = best(table, groups, sort_keys, unique, n)
        if kept.num_rows:
            yield from kept.append_column(rank, pa.array(ranks, pa.int32())).combine_chunks().to_batches()

    few = slim.mapInArrow(combine, slim.schema).repartition(*groups).sortWithinPartitions(*groups)
    return few.mapInArrow(merge, T.StructType([*slim.schema.fields, T.StructField(rank, T.IntegerType())]))
