"""What the operators of this subpackage share: staging, shipping, text and array helpers."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import os
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine (tests).
LOCAL_SHARED = "file:///tmp/checkpoints/factlake"

#: Words are maximal runs of characters outside this class.
SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

_ROOT = Path(__file__).resolve().parents[2]
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local default on one machine only."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; local ones are removed when the driver ends."""
    path = f"{shared_dir(spark)}/factlake-{uuid.uuid4().hex}/{name}"
    if path.startswith("file:"):
        if not _made:
            atexit.register(lambda: [shutil.rmtree(p, ignore_errors=True) for p in _made])
        _made.append(re.sub("^file:/+", "/", path.rpartition("/")[0]))
    return path


def stage(df: DataFrame, name: str, after: tuple[DataFrame, ...] = (), rest: float = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    after: staged tables that nothing needs any more once this one is written; their files go.
    rest: seconds to wait for the cleaner. Shuffle files of the finished job are released at once instead of at some later
    collection, but by a thread of their own.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    for old in after:
        discard(old)
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
        time.sleep(rest)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables (as ``stage`` returned them) that nothing reads any more."""
    for df in tables:
        path = None if df is None else vars(df).get("staged_at")
        if path is None:
            continue
        context = df.sparkSession.sparkContext
        jvm = context._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
        df.staged_at = None


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system: workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def light(run):
    """A function of a Python worker that gives its memory back when it is done."""
    if inspect.isgeneratorfunction(run):

        def walk(batches):
            try:
                yield from run(batches)
            finally:
                release()

        return walk

    def call(group):
        try:
            return run(group)
        finally:
            release()

    def call_two(group, other):
        try:
            return run(group, other)
        finally:
            release()

    return call if len(inspect.signature(run).parameters) == 1 else call_two


def prepare(spark: SparkSession) -> None:
    """Ship this package to executors that can't import it and bound Arrow batches by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_factlake_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "factlake.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((_ROOT / "factlake").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    sc._factlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: how much there is to do, however well the files are compressed."""
    return int(docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def buckets_for(size: int, each_mb: int = 4, least: int = 32) -> int:
    """Buckets to deal ``size`` bytes of text into so that one answers to about ``each_mb`` MB."""
    return int(min(1 << 20, max(least, size // (each_mb << 20))))


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_keys(docs: DataFrame, nulls_first: bool = True, each: bool = False) -> DataFrame:
    """Adds ``id``, a key of the row in the order of doc_id: doc_id itself where none is null or repeats.

    Else rows are numbered once and staged. Rows with a null doc_id are documents of their own; rows with
    one doc_id share a key only if their texts are equal, and not even then with ``each``.
    """
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn("id", F.col("doc_id"))
    row = F.monotonically_increasing_id()
    names = ["absent", "named", "digest", "row"]
    rows = stage(
        docs.withColumn("absent", F.col("doc_id").isNull() != F.lit(nulls_first))
        .withColumn("named", F.coalesce("doc_id", F.lit(0)).cast("long"))
        .withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        .withColumn("row", row if each else F.when(F.col("doc_id").isNull(), row).otherwise(F.lit(-1).cast("long"))),
        "rows",
    )
    # Ranges are in order and each is sorted, so the numbers rise with the names over all of them.
    numbered = stage(
        rows.select(*names).distinct().repartitionByRange(*names).sortWithinPartitions(*names).withColumn("id", row), "row_keys"
    )
    return stage(rows.join(numbered.hint("merge"), names).drop(*names), "keyed")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd multiplier, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or those of its inverse."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            steps = np.full(size, _INVERSE if inverse else BASE, np.uint64)
            steps[0] = 1
            have = _powers[key] = np.multiply.accumulate(steps)
    return have[:n]


class RollingHash:
    """64-bit hashes of any ranges of one array, from prefix sums; equal ranges have equal hashes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix64(values.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.sums[1:])
        self.n = n

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * powers(self.n + 1, True)[start]
            return mix64(x + (end - start).astype(np.uint64) * BASE)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as array, starts, ends) of the words of UTF-8 text."""
    a = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(a) + 2, np.int8)
    solid[1:-1] = ~_SPACE[a]
    edge = np.diff(solid)
    return a, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word of the text, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    a, start, end = word_spans(text.encode("utf-8", "surrogatepass"))
    if not len(start):
        return np.zeros(0, np.uint64)
    return RollingHash(_LOWER[a] if lower else a).of(start, end)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the ranges."""
    diff = np.zeros(n + 1, np.int64)
    np.add.at(diff, starts, 1)
    np.add.at(diff, ends, -1)
    return np.cumsum(diff[:-1]) > 0


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as sorted disjoint ranges (touching ones join)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], s[1:] > e[:-1]])
    return s[first], e[np.concatenate([first[1:], [True]])]
