"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (as in tests) a
    temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """A run's intermediate tables in the shared folder; what later plans don't read is removed early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def remove(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo; a null id has remainder -1 (never held out)."""
    text = F.col(column).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % modulus, F.lit(-1))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def texts(batch, id_name: str = "doc_id", text_name: str = "text"):
    """(row, id scalar, text or '') of an Arrow batch, one Python string at a time."""
    ids, column = batch.column(id_name), batch.column(text_name)
    for i in range(batch.num_rows):
        yield i, ids[i], column[i].as_py() or ""


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (splitmix64's finaliser) over uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x100000001B3)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 4096), _STEP)
            steps[0] = 1
            _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word between blanks (space, tab, line ends), in order."""
    codes = np.frombuffer(raw, np.uint8)
    inside = ~_BLANK[codes]
    if not inside.any():
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    lengths = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        each = (codes[inside].astype(np.uint64) + np.uint64(1)) * _power_table(int(lengths.max()))[place]
        return mix64(np.add.reduceat(each, starts) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words; of all words if there are fewer."""
    n = len(words) - width + 1
    if len(words) == 0:
        return words
    with np.errstate(over="ignore"):
        if n < 1:
            n, width = 1, len(words)
        key = np.full(n, width, np.uint64)
        for i in range(width):
            key = mix64(key * np.uint64(31) + words[i : i + n])
    return key


CELL_CHUNK = 1 << 14


def pack_cells(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Chunks' numbers and compressed counts of a task's table of hashed counts; empty chunks are left out."""
    parts = counts.astype("<i8").reshape(-1, CELL_CHUNK)
    used = [i for i, p in enumerate(parts) if p.any()]
    return used, [zlib.compress(parts[i].tobytes(), 1) for i in used]


def merged_cells(rows: DataFrame, cells: int) -> np.ndarray:
    """The sum of packed tables (chunk, counts) of all tasks: a table of fixed size."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CELL_CHUNK, np.int64)
        for x in t["counts"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        return pa.table({"chunk": t["chunk"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    merged = rows.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").toArrow()
    counts = np.zeros(cells, np.int64)
    for i, x in zip(merged["chunk"].to_pylist(), merged["counts"].to_pylist(), strict=True):
        counts[i * CELL_CHUNK : (i + 1) * CELL_CHUNK] = np.frombuffer(x, "<i8")
    return counts


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of values as binary items."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


def unpacked(items: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of binary items, one after the other, and how many each has."""
    offsets = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1]
    data = items.buffers()[2]
    if not len(items) or data is None:
        return np.empty(0, kind), np.zeros(len(items), np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(kind), np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize
