"""What the training-data operators share: the shared folder, written tables, Arrow text batches and word hashes.

Words are maximal runs of `[^\\x20\\x09-\\x0D]`, which is what `bytes.split()` yields on UTF-8.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset (tests on a local master) a temporary folder takes its place until the process ends; a cluster
    without the setting is an error, since no folder of one machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        folder = tempfile.mkdtemp(prefix="parlance-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own["dir"] = f"file://{folder}"
    return _own["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/parlance/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """`df` as a table written in the shared folder: cuts the lineage, survives lost executors, gives Catalyst its size.

    The shuffle files of the job that wrote it are of no further use, and Spark is asked to delete them when the job ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, *measures: Column) -> tuple[DataFrame, tuple]:
    """`materialize`, and aggregates of the rows that the same job takes on its way (null: 0)."""
    seen = Observation()
    table = materialize(df.observe(seen, *(m.alias(f"m{i}") for i, m in enumerate(measures))), label)
    return table, tuple(seen.get.get(f"m{i}") or 0 for i in range(len(measures)))


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/parlance/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size, from file sizes; no job runs. 0 where it knows none (its default is huge)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else 0


def partitions(df: DataFrame, mb: float = 16) -> int:
    """Partitions for an exchange that carries about as much as `df` holds: they follow the input's size."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(100_000, max(1, conf, math.ceil(bytes_of(df) / (mb * 1e6))))


def words_count(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `most` bytes of text, one row at least: bounds a worker's memory."""
    for batch in batches:
        text = batch.column(column)
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the offsets of each (null: empty)."""
    array = pc.fill_null(array, "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(array) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(array) else np.zeros(1, np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in `data`, and for each text the index of its first word (one more entry at the end)."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes: a polynomial over the span, from prefix sums, then a finaliser."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    have = len(_powers.get("up", ()))
    if have < n + 1:
        with np.errstate(over="ignore"):
            size = max(n + 1, 1 << 20)
            up = np.full(size, _ODD, np.uint64)
            up[0] = 1
            _powers["up"] = np.multiply.accumulate(up)
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            down = np.full(size, inverse, np.uint64)
            down[0] = 1
            _powers["down"] = np.multiply.accumulate(down)
    up, down = _powers["up"], _powers["down"]
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are left out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1].copy()
        for i in range(1, n):
            out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + words[i : len(words) - n + 1 + i])
    return out
