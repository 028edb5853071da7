"""Comparing the members of groups in blocks, without a row for each pair.

A group's members are dealt by a hash to blocks of bounded size, and every two blocks that
can hold a pair meet in one task. A task reports two things: how many rows each member is
linked with, and links enough to keep what is connected connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LINKS = "a long, b long, n long"
Compare = Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def spanning(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (root, node) that connect what the links a-b connect among 0..size-1."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(size))
    return label[node], node


def tasks(rows: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that come sorted by their first `keys` columns, one table a key."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in rows:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = first != last
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        if cuts[0] > 0:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def compared(rows: DataFrame, keys: list[str], compare: Compare) -> DataFrame:
    """(a, b, n): for b null, n rows are linked with a in one task; else a link to keep.

    `compare` gets the rows of one task and returns ids, counts, and the two ends of links
    among the rows, by position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tasks(batches, len(keys)):
            ids, counts, left, right = compare(table)
            linked = np.flatnonzero(counts)
            if not len(linked):
                continue
            root, node = spanning(left, right, len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[linked], ids[root]]), pa.int64()),
                    pa.array([None] * len(linked) + ids[node].tolist(), pa.int64()),
                    pa.array(np.concatenate([counts[linked], np.zeros(len(root), np.int64)]), pa.int64()),
                ],
                names=["a", "b", "n"],
            )

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, LINKS)
