"""All members of a group meet, without one task that holds the group and without a row per pair.

A group of more than `size` rows is dealt into chunks, and every two chunks meet in a block of
their own, so a block has about 2 * size rows however large its group. Blocks are runs of a sorted
partition and are compared there by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def chunked(rows: DataFrame, keys: list[str], member: str, size: int = BLOCK, weight: str | None = None, most: int = 1 << 23) -> DataFrame:
    """Rows of groups of two or more, with the number `_m` of the group's chunks and the row's own, `_c`.

    A chunk has about `size` rows, and with a `weight` per row (bytes) no more than about `most` of it.
    """
    parts = F.ceil(F.col("_n") / F.lit(size))
    sums = [F.count(F.lit(1)).alias("_n")]
    if weight:
        sums.append(F.sum(F.col(weight).cast("double")).alias("_w"))
        parts = F.greatest(parts, F.least(F.ceil(F.col("_w") / F.lit(most)), F.col("_n")))
    n = rows.groupBy(*keys).agg(*sums).where("_n > 1")
    r = rows.join(n, keys).withColumn("_m", parts.cast("int"))
    return r.withColumn("_c", F.pmod(F.xxhash64(member, *keys), F.col("_m")).cast("int")).drop("_n", "_w")


def paired(rows: DataFrame) -> DataFrame:
    """Chunked rows once per chunk that theirs meets, with `_i`, `_j` (the block).

    In block (i, i) all pairs are to be compared, in block (i, j) those of different chunks; so
    every pair of a group meets in one block.
    """
    r = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return r.withColumn("_i", F.least("_c", "_o")).withColumn("_j", F.greatest("_c", "_o")).drop("_o", "_m")


def block_pairs(rows: DataFrame, keys: list[str], member: str, size: int = BLOCK) -> DataFrame:
    return paired(chunked(rows, keys, member, size))


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each block in a run of one sorted partition, for `runs`."""
    return rows.repartition(*keys, "_i", "_j").sortWithinPartitions(*keys, "_i", "_j")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks from sorted batches, with the index of the block of each row."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        group = _changes(pa.Table.from_batches([b]), keys)
        cut = int(np.flatnonzero(group)[-1])
        if held and not _same(held[-1], b, keys):
            yield _table(held, keys)
            held = []
        if cut:
            yield _table([*held, b.slice(0, cut)], keys)
            held = []
        held.append(b.slice(cut))
    if held:
        yield _table(held, keys)


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        x = t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[0] for k in (a.schema.get_field_index(x) for x in keys))


def _table(parts: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(parts).combine_chunks()
    return t, np.cumsum(_changes(t, keys)) - 1


def pairs(group: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare in the blocks of a table, by their distance, a bounded number at a time."""
    left = np.arange(len(group))
    for d in range(1, len(group)):
        left = left[left + d < len(group)]
        left = left[group[left] == group[left + d]]
        if not len(left):
            return
        a = left[(i[left] == j[left]) | (chunk[left] != chunk[left + d])]
        if len(a):
            yield a, a + d


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that links (a, b) reach from each of n rows."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
