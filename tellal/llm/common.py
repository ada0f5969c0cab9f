"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of the pieces in which an operator sees its input. Spark bounds the batches
#: themselves, by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set otherwise).
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
#: The folder below which a caller wants all intermediate tables.
SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with whatever other columns are asked for; the rest is pruned at the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).alias("none"))
    return texts(docs, held.alias("rest"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in columns])


def with_fields(schema: str, df: DataFrame, keep: tuple[str, ...]) -> StructType:
    """The schema with the fields of df named in keep after its own."""
    return StructType([*StructType.fromDDL(schema).fields, *(df.schema[c] for c in keep)])


def in_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose function sees small pieces of the batches, whatever the session's bounds are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        return fn(sliced(batches))

    return df.mapInArrow(run, schema)


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of BATCH_ROWS rows and about BATCH_BYTES bytes at most; one row is never cut."""
    for batch in batches:
        if batch.nbytes <= BATCH_BYTES:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(k, BATCH_ROWS)
            continue
        sizes = sum(_row_bytes(c) for c in batch.columns)
        begin, total = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if k > begin and (k - begin == BATCH_ROWS or total + size > BATCH_BYTES):
                yield batch.slice(begin, k - begin)
                begin, total = k, 0
            total += size
        yield batch.slice(begin)


def _row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a text or binary column; of others, their average."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.diff(offsets).astype(np.int64) + 8
    return np.full(len(column), column.nbytes // max(1, len(column)) + 1, np.int64)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors all see: below spark.checkpoint.dir, and only where
    that is unset and all run on one machine, as in tests, below a local temporary folder."""
    return f"{SCRATCH.get() or checkpoint_root(spark)}/tellal-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or tempfile.mkdtemp(prefix="tellal-checkpoint-")).rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside go to a folder of their own, which is deleted at the end;
    results that still depend on them must have been written by then."""
    folder = shared_dir(spark)
    token = SCRATCH.set(folder)
    try:
        yield
    finally:
        SCRATCH.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df cut off from its lineage: written to the shared folder and read back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, mod: int) -> F.Column:
    """crc32 of a number's decimal text, modulo mod; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod
