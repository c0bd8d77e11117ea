"""Shared vectorised text scanning for the training-data operators.

Scans work on Arrow buffers in slices of bounded byte size, so what they hold
depends on the longest document, never on the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and 0x09-0x0D.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of text handled at once inside one Arrow batch.
SLICE_BYTES = 1 << 19

_U = np.uint64
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit of a hash is usable."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_TABLE_LOWER = _TABLE[LOWER]
_BASE = 0x2545F4914F6CDD1D | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bufs = column.buffers()
    n = len(column)
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most `limit` bytes each; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets from 0) for each bounded slice."""
    data, offsets = buffers(column)
    for a, b in row_slices(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def scan_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's bounds among them."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_WHITE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit polynomial hashes of byte spans from one prefix sum over the slice."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = (_TABLE_LOWER if lower else _TABLE)[data]
    values *= _powers(_BASE, n)[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_BASE_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions are cut."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = _U(0xD6E8FEB86659FD93)
    for j in range(k):
        out *= step
        out += words[j : j + n]
    return mix(out)


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count) for all pairs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def fresh(df, *names: str) -> list[str]:
    """Column names that begin like `names` and are not in `df`, in no case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def column(name: str):
    """A top-level column, whatever its name."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_batches(df, run, schema):
    """mapInArrow for tables whose columns may have any names; `run` finds columns by their places."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


#: Rows of an Arrow batch of texts, where the session has Spark's default of ten thousand.
BATCH_ROWS = 1000


def bounded_batches(spark) -> None:
    """Fewer rows in an Arrow batch: texts are long, and a batch is held several times over on its way.

    This sets the session's value, and leaves it set, as batches are cut when a plan runs and not when it is made. A value that the user chose stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, BATCH_ROWS)


def read(spark, sf_dir: str, table: str):
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df, eager: bool = True):
    """`df` with its lineage cut by a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir. Where that is
    unset, as in tests, a folder in the warehouse is used, but only by a local master.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def shared_folder(spark) -> str:
    """Where driver and executors both write: spark.checkpoint.dir, or on a local master a folder in the warehouse."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir")
    if not place and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (place or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")
