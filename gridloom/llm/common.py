"""Shared plumbing of the training-data operators: scratch tables, joins behind a size check, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import drop_scratch, scratch_path, shared_dir

__all__ = ["drop_scratch", "scratch_path", "shared_dir"]

#: Bytes up to which a side is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of a batch of rows that goes to Python, where the session doesn't say otherwise: very long texts come few at a time.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: `[^\x20\x09-\x0D]+`, the words that all operators count and compare.
WORD = r"[^\x20\x09-\x0D]+"

_released = 0.0


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and a lost executor loses nothing."""
    out = runtime.scratch(df, name)
    release(df.sparkSession)
    return out


def release(spark: SparkSession, every: float = 4.0) -> None:
    """Let Spark delete the shuffle files of steps that are done, which otherwise stay until the driver collects garbage."""
    global _released
    if time.monotonic() - _released >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, and bound the batches that they get, unless the application
    says how large they may be: plans are made when results are read, so the session keeps the bound."""
    if spark.sparkContext.getConf().get(BATCH_KEY) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    runtime.ship(spark)


def trimmed(go):
    """A function of batches that leaves its worker's memory as it found it, as Spark keeps workers for other tasks."""

    def run(batches):
        yield from go(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def join_small(big: DataFrame, side: DataFrame, keys: list[str], how: str, row_bytes: int = 48, sized: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a materialised side: broadcast if its measured size is within the limit, else shuffled.

    row_bytes: fixed bytes of a row of side, to which a hash table adds about 40; sized: its binary column, whose length
    counts too.
    """
    n, extra = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(sized)), F.lit(0)) if sized else F.lit(0)).first()
    return big.join(F.broadcast(side) if n * (row_bytes + 40) + extra <= limit else side, keys, how)


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in b.columns], b.schema.names)


def collect_longs(df: DataFrame) -> list[np.ndarray]:
    """The columns of longs of a small table, 8 bytes a value on the driver: they come packed, not as rows."""
    ship(df.sparkSession)
    rows = df.mapInArrow(_packed, ", ".join(f"`{c}` binary" for c in df.columns)).collect()
    return [np.frombuffer(b"".join(bytes(r[k]) for r in rows), np.int64) for k in range(len(df.columns))]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """Texts without nulls (empty instead), starting at the first byte of their buffer."""
    x = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(x.type):
        x = x.cast(pa.large_string())
    x = pc.fill_null(x, "")
    return pa.concat_arrays([x]) if x.offset else x


def raw(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets into them."""
    _, off, data = x.buffers()
    offsets = np.frombuffer(off, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
