"""What the operators of this subpackage share: tables, the shared folder, Arrow row mapping, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be megabytes long, so batches stay short.
ARROW_ROWS = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts takes; read when a plan is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one if the master is
    local, as in tests; on a cluster that is an error, since each machine would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base if "://" in base else ("file:" + base if base.startswith("/") else base)


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner then clears it
            return


atexit.register(_forget)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back; the shuffle files that the write needed go when it ends, not when garbage is collected."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    out = write(df, path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once all that was made of it is written itself."""
    _delete(df.sparkSession, df.stored_path)


#: A key with more than one in so many of all rows is hot; there are at most as many hot keys, whatever the table's size.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, side: DataFrame, on: str, n: str, total: int, least: int = 100_000) -> DataFrame:
    """``rows`` joined (inner) with ``side(on, n, ...)``, a stored table of one row per key; n counts the key's rows; drops n.

    Keys with more than ``total`` / HOT_SHARE (and ``least``) of the rows are broadcast: at most HOT_SHARE of them, so
    the bound holds for any table. The others are joined by a shuffle, in which no key has more rows than that.
    """
    bound = max(least, total // HOT_SHARE)
    hot = side.where(F.col(n) > bound).drop(n)
    cold = side.where(F.col(n) <= bound).drop(n)
    if total <= least or hot.isEmpty():
        return rows.join(side.drop(n), on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: Lower-cases A-Z and turns every ASCII byte that is neither digit nor letter into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


_REMEMBERED: dict[Hashable, object] = {}


def remembered(key: Hashable, make: Callable[[], object]) -> object:
    """What this process keeps from task to task under ``key``, one thing at a time: Spark's workers live through all of a
    job's stages, and what an earlier stage has learnt goes when another one's is asked for."""
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """Let go of what is remembered, and give memory that is free back to the system: an idle worker keeps it otherwise."""
    _REMEMBERED.clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # glibc only
        pass


def forgetting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for tasks that leave nothing behind in their worker, and begin without what others have left."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from run(batches)
        finally:
            forget()

    return task


class WordHashes(dict):
    """Word -> its XXH64 as 8 little-endian bytes; forgets all when it holds too many."""

    def __init__(self, seed: int = 0, most: int = 250_000) -> None:
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(word, self.seed).to_bytes(8, "little")
        if len(word) <= 64:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u8")


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "<u8")


def shingle_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words; fewer words: one for the whole sequence; none: none."""
    n = min(size, len(hashed))
    if n == 0:
        return hashed
    total = np.zeros(len(hashed) - n + 1, "<u8")
    for j in range(n):
        part = hashed[j : len(hashed) - n + 1 + j]
        total += (part ^ (part >> np.uint64(29))) * _MIX[j]
    total ^= total >> np.uint64(32)
    total *= _MIX[5]
    return total ^ (total >> np.uint64(29))
