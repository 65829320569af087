"""Helpers shared by the text operators: table reading, durable
intermediate tables, an Arrow batch wrapper and 64-bit word hashing."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hazardlens.session import checkpoint_dir

# ASCII blanks that separate words; everything else belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage; a lost executor costs at most the tasks it ran.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_KEYS = 1_000_000  # at most so many keys (16 bytes each) are sent to all tasks


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` columns occur in ``keys``. Few keys, by count, are
    broadcast, so the other rows are dropped before any shuffle; more are joined."""
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return rows.join(side, on, "left_semi")


SLICE_ROWS = 1000  # rows turned into Python values at a time
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold ``SLICE_ROWS`` rows at most: buffers
    outside the heap are as large as a batch of texts, on both sides of a
    worker's pipe, and a task keeps them. A smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= SLICE_ROWS:
        spark.conf.set(BATCH_ROWS, str(SLICE_ROWS))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task,
    and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE_ROWS`` rows."""
    for b in batches:
        if b.num_rows <= SLICE_ROWS:
            yield b
        else:
            for at in range(0, b.num_rows, SLICE_ROWS):
                yield b.slice(at, SLICE_ROWS)
            give_back()


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` over dicts of Python lists.

    ``make`` runs once per task and returns the function applied to each
    batch, so per-task state (caches, automata) is built in one place.
    Integers stay exact and nulls stay None.
    """
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in slices(batches):
            cols = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                      for f, c in ((f, cols[f.name]) for f in arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        fn = b = cols = arrays = None
        give_back()

    return df.mapInArrow(run, schema)


_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)  # multiplier of the rolling sums, odd, so it has an inverse
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash per word of the UTF-8 text, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_BLANK[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return _spans_hash(raw.astype(np.uint64) + np.uint64(1), edges[0::2], edges[1::2])


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash per run of ``size`` consecutive words (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return _spans_hash(hashes, starts, starts + size)


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word range [start, end)."""
    return _spans_hash(hashes, starts, ends)
