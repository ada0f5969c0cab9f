"""Hot keys: finding them, and joining without bringing all their rows to one task.

At most ``MOST`` keys can each hold more than 1/MOST of all rows. Those may be sent to every task;
the rows of any other key are a bounded share, whatever the distribution is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

MOST = 100_000
#: Keys that a task counts at a time.
CHUNK = 4_000_000


def limit(total: int, least: int) -> int:
    """Rows beyond which a key is hot."""
    return max(least, total // MOST)


def hot_keys(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], total: int, least: int) -> np.ndarray:
    """The 64-bit keys that more rows than the limit have (some with half as many may be among them),
    sorted; 2 * MOST at most. Tasks count what they read and report what is frequent there, so a key
    costs a row a chunk. Keys that are overlooked, as they could be where tasks are very many and tiny,
    are joined like any other."""
    most = limit(total, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def frequent() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            use = count >= max(2, n // (2 * MOST))
            return pa.RecordBatch.from_arrays([pa.array(key[use].view(np.int64)), pa.array(count[use])], ["key", "n"])

        for batch in batches:
            held.append(keys(batch))
            n += len(held[-1])
            if n >= CHUNK:
                yield frequent()
                held, n = [], 0
        if held:
            yield frequent()

    rows = in_batches(df, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most // 2)
    return np.sort(np.array([r["key"] for r in rows.select("key").collect()], np.int64).view(np.uint64))


def among(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def left_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, least: int = 1000) -> DataFrame:
    """rows left-joined with keyed, which has one row a key and in ``count`` how many rows have it. Hot
    keys' rows are joined where they are (MOST keys at most are broadcast), the others are shuffled."""
    most = limit(total, least)
    hot = keyed.where(F.col(count) > most).drop(count)
    stay = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(count) <= most).drop(count), key, "left")
    return stay.unionByName(rest)
