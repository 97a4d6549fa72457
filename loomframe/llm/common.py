"""What the corpus operators share: shipping code, cutting lineage, Arrow text as bytes, word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once in a Python worker (a longer text is taken alone, whole).
CHUNK_BYTES = 1 << 20

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="loomframe-")
    archive = os.path.join(folder, "loomframe_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a session on one machine may do without a named one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's checkpoint folder and go on from there; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in a new folder under the shared one: what goes on from a table does not need what made it.

    The shuffle files behind a table go once it is written, a table goes with drop(), and what is left
    goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/loomframe-{uuid.uuid4().hex}"
        self.made = 0
        self.fs, path = self._path(self.folder)
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, *by: str) -> DataFrame:
        """`df`, read from files from now on, in folders by the values of `by`."""
        self.made += 1
        where = f"{self.folder}/{self.made}"
        conf = self.spark.conf
        before = conf.get(_CLEAN, "false")
        conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "snappy").partitionBy(*by).parquet(where)
        finally:
            conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.scratch = where
        return out

    def size(self, table: DataFrame) -> int:
        """Bytes of its files."""
        fs, path = self._path(table.scratch)
        return fs.getContentSummary(path).getLength()

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            fs, path = self._path(df.scratch)
            fs.delete(path, True)


def plain_names(df: DataFrame, *given: str) -> tuple[DataFrame, list[str], list[str]]:
    """`df` under names that clash with nothing (c0, c1, ...), the names it had, and the new names of `given`."""
    had = df.columns
    now = [f"c{k}" for k in range(len(had))]
    return df.toDF(*now), had, [now[had.index(c)] for c in given]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Texts:
    """Rows of one text column as bytes: row i is data[start[i]:end[i]]; null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        self.n = len(column)
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        first, last = int(ends[0]), int(ends[-1])
        self.data = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        self.offsets = ends - first
        self.start, self.end = self.offsets[:-1], self.offsets[1:]

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def strings(values: list[bytes] | list[str]) -> pa.Array:
    return pa.array(values, pa.large_string() if values and isinstance(values[0], bytes) else pa.string())


_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; range_hash() of two equal byte ranges is equal."""
    up, _ = _power(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: Texts, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that do not cross rows: (start, end, first word of each row and the total)."""
    if not len(texts.data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(texts.n + 1, np.int64)
    flag = is_word[texts.data]
    edge = np.empty(len(flag) + 1, bool)
    edge[0], edge[-1] = flag[0], flag[-1]
    edge[1:-1] = flag[1:] != flag[:-1]
    inner = texts.offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(flag))])
    split = inner[flag[inner] & flag[inner - 1]]  # a word ends and the next begins where rows meet
    at = np.flatnonzero(edge)
    if len(split):
        at = np.sort(np.concatenate([at, split, split]), kind="stable")
    start, end = at[0::2], at[1::2]
    return start, end, np.searchsorted(start, texts.offsets)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
