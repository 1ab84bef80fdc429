"""Helpers shared by the training-data operators: words, Arrow batches, shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words; ``bytes.split()`` splits on exactly these.
WHITE = " \t\n\x0b\x0c\r"
#: Rows and bytes of one Arrow batch handed to Python, so that long texts stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else, where everything runs in one process, a folder of our own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("cohortarium.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cohortarium-")
        spark.conf.set("cohortarium.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of what is now written go when the driver's JVM collects
    return spark.read.schema(df.schema).parquet(path)


def shrink_executors(spark: SparkSession) -> None:
    """Every executor's JVM collects its garbage, and gives back what its heap and native memory then have free.

    Else a heap that one stage of a long job has filled stays as large beside the next one's Python workers. Executors
    that are idle get one task each; where the driver is the only one, ``written`` has done it.
    """
    executors = len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1
    if executors > 0:
        spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc') done").write.format("noop").mode("overwrite").save()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


#: Caches that outlive a task in a Python worker, which other operators' tasks then share.
CACHES: list[dict] = []
_LIBC: list = []


def fresh(caches: bool = False) -> None:
    """Gives the worker's free memory back and, unless a task has use for them, empties its caches.

    glibc's malloc is told to keep few arenas and to return large blocks at once.
    """
    for c in CACHES if not caches else ():
        c.clear()
    with contextlib.suppress(OSError, AttributeError):
        if not _LIBC:
            _LIBC.append(ctypes.CDLL("libc.so.6"))
        for option, value in ((-8, 2), (-3, 1 << 18), (-1, 1 << 18)):  # M_ARENA_MAX, M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            _LIBC[0].mallopt(option, value)
        pa.default_memory_pool().release_unused()
        _LIBC[0].malloc_trim(0)


def reuse_freed() -> None:
    """Until the next ``fresh``, freed arrays of up to 16 MB stay with the worker: for tasks that make such again and again,
    which otherwise wait for the kernel to clear each page anew.
    """
    for option, value in ((-3, 1 << 24), (-1, 1 << 25)) if _LIBC else ():
        _LIBC[0].mallopt(option, value)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which the worker gives its free memory back: idle workers outnumber those at work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            fresh(caches=True)

    return wrapped


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, caches: bool = False) -> DataFrame:
    """Applies fn to every Arrow batch of df; caches says whether fn uses the worker's caches."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(caches)
        for b in batches:
            out = fn(b) if b.num_rows else None
            if out is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(tidy(run), schema)


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def word_lists(column: pa.Array) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text, as UTF-8; a null has none."""
    for x in column.cast(pa.binary()).to_pylist():
        yield x.split() if x else []


class Bounded(dict):
    """A cache that is emptied when it holds ``most`` entries."""

    def __init__(self, make: Callable[[list], list], most: int = 250_000):
        super().__init__()
        self.make, self.most = make, most

    def get_all(self, keys: list) -> list:
        out = list(map(self.get, keys))
        if None in out:
            missing = list(dict.fromkeys(k for k, v in zip(keys, out, strict=True) if v is None))
            if len(self) + len(missing) > self.most:
                self.clear()
                missing = list(dict.fromkeys(keys))
            self.update(zip(missing, self.make(missing), strict=True))
            out = list(map(self.__getitem__, keys))
        return out


_MULT = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1) for j in range(64)]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += words[j : j + n] * _MULT[j]
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hash_words(words: list[bytes]) -> np.ndarray:
    """xxHash64 of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    step = 1
    while step < width:
        more = min(step, width - step)
        x = np.minimum(x[: len(x) - more], x[more:])
        step += more
    return x


def column_or_null(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
