"""Token-id files as directly addressable codes.

Each id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those that
need more, and so on. A level's bitmap marks the ids that continue; a rank directory (ones before every 512 bits)
gives the place in the next level, so any id is read with a few bytes per level and no block is decoded.

File: ``DAC1``, then unsigned 64-bit little-endian numbers: levels, ids, documents; for each level its number of
chunks; then the documents' ids, their starts (and the end), and for each level chunks, bitmap, directory, each
part padded to 8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import batch, map_batches, new_path, small_batches, write
from .tokens import END_ID, ChunkEncoder

MAGIC = b"DAC1\0\0\0\0"
RANK_BITS = 512
#: Ids after which a file ends (at a document's end): bounds a writer's memory.
FILE_IDS = 4_000_000


def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def encode(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file's bytes for these ids; document i owns ids[starts[i]:starts[i + 1]]."""
    sizes, parts, rest = [], [], ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += bytes(-len(bits) % (RANK_BITS // 8))
        ones = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, RANK_BITS).sum(1, dtype=np.uint64) if bits else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)]).astype("<u8")
        sizes.append(len(rest))
        parts += [_pad((rest & 255).astype(np.uint8).tobytes()), bits, ranks.tobytes()]
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    head = np.array([len(sizes), len(ids), len(doc_ids), *sizes], "<u8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), *parts])


class DacFile:
    """Reads such a file, wholly or one id at a time; ``read(at, n)`` gives bytes of it."""

    def __init__(self, read) -> None:
        self.read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a token-id file")
        levels, self.n_ids, self.n_docs = (int(x) for x in np.frombuffer(read(8, 24), "<u8"))
        self.sizes = [int(x) for x in np.frombuffer(read(32, 8 * levels), "<u8")]
        self.docs_at = at = 32 + 8 * levels
        at += 8 * self.n_docs + 8 * (self.n_docs + 1)
        self.places = []
        for n in self.sizes:
            bits = -(-n // RANK_BITS) * (RANK_BITS // 8)
            chunks = n + -n % 8
            self.places.append((at, at + chunks, at + chunks + bits))
            at += chunks + bits + 8 * (bits * 8 // RANK_BITS + 1)

    @classmethod
    def of(cls, data: bytes) -> DacFile:
        return cls(lambda at, n: data[at : at + n])

    def __getitem__(self, i: int) -> int:
        """Id i, by one chunk, one bit and one rank of each level that it has."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.places):
            value |= self.read(chunks + i, 1)[0] << (8 * level)
            if not self.read(bits + i // 8, 1)[0] >> (i % 8) & 1:
                return value
            block = i // RANK_BITS
            before = int(np.frombuffer(self.read(ranks + 8 * block, 8), "<u8")[0])
            whole = self.read(bits + block * RANK_BITS // 8, (i % RANK_BITS) // 8 + 1)
            inside = int.from_bytes(whole, "little") & ((1 << (i % RANK_BITS)) - 1)
            i = before + inside.bit_count()
        return value

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.n_docs
        return np.frombuffer(self.read(self.docs_at, 8 * n), "<i8"), np.frombuffer(self.read(self.docs_at + 8 * n, 8 * (n + 1)), "<u8")

    def all(self) -> np.ndarray:
        deeper: np.ndarray | None = None
        for n, (chunks, bits, _) in reversed(list(zip(self.sizes, self.places))):
            own = np.frombuffer(self.read(chunks, n), np.uint8).astype("<u4")
            if deeper is not None:
                more = np.unpackbits(np.frombuffer(self.read(bits, -(-n // 8)), np.uint8), count=n, bitorder="little").view(bool)
                own[more] |= deeper << np.uint32(8)
            deeper = own
        return deeper if deeper is not None else np.zeros(0, "<u4")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    path = path.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


MANIFEST = "part int, seg int, path string, n_docs long, n_ids long"
_MANIFEST = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"
_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def write_ids(docs: DataFrame, vocabulary: str, *, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write ids in ascending doc_id order; returns the files' manifest.

    Files and manifest go to the new folder ``path`` and stay there (``open_ids`` finds them again); without one, to the
    shared folder until the driver ends. Texts of any length are encoded whole, and a document lies in one file.

    Null text: only the end id. Null doc_id: sorted first, stored as the smallest long. Equal doc_ids: in order of
    their texts' hashes; repeated rows stay. Empty table: no file. Other columns are ignored. Rows are
    range-partitioned by (doc_id, hash), so a doc_id with many rows splits too; a task streams through its range
    and writes a file whenever ``file_ids`` ids are reached, to an attempt's own name, then renames it: a task that
    runs again gives the same files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = path.rstrip("/") if path else new_path(spark, "token-ids")
    root = "file:" + root if root.startswith("/") else root
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text"), F.xxhash64("text").alias("__tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, base = _open(root)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt, seg = task.partitionId(), task.taskAttemptId(), 0
        encoder, tail = ChunkEncoder.shared(vocabulary), np.array([end_id], "<u4").tobytes()
        held, ids, n = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, n, seg
            path = f"{base}/part-{part:06d}-{seg:04d}.dac"
            lengths = np.fromiter((len(b) // 4 for b in ids), "<u8", len(ids))
            data = encode(np.frombuffer(b"".join(ids), "<u4"), np.array(held, "<i8"), np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")]))
            with where.open_output_stream(f"{path}.{attempt}.tmp") as out:
                out.write(data)
            where.move(f"{path}.{attempt}.tmp", path)
            row = batch(_MANIFEST, {"part": [part], "seg": [seg], "path": [f"{root}/{path.rsplit('/', 1)[1]}"], "n_docs": [len(held)], "n_ids": [n]})
            held, ids, n, seg = [], [], 0, seg + 1
            return row

        for b in batches:
            texts = b.column(1).to_pylist()
            for doc, own in zip(b.column(0).to_pylist(), encoder.encode(texts)):
                held.append(doc)
                ids.append(own + tail)
                n += len(own) // 4 + 1
                if n >= file_ids:
                    yield flush()
        if held:
            yield flush()

    return write(map_batches(ordered, encode_rows, MANIFEST), f"{root}/manifest")


def open_ids(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a folder that ``write_ids`` filled."""
    return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read the files back: per document its start over all files, its number of ids and their checksum.

    Starts are running totals within each part, over few files, and over the parts' sums, as many rows as there were
    shuffle partitions.
    """
    spark = manifest.sparkSession
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_base"))
    inside = manifest.withColumn("own_base", before(Window.partitionBy("part").orderBy("seg")))
    files = inside.join(bases, "part").withColumn("base", F.col("own_base") + F.col("part_base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, name = _open(path)
                with where.open_input_stream(name) as f:
                    stored = DacFile.of(f.read())
                docs, starts = stored.documents()
                raw, cut = memoryview(stored.all().astype("<u4").tobytes()), (starts * 4).tolist()
                yield batch(_OUT, {"doc_id": docs, "start": starts[:-1].astype(np.int64) + base, "n_tokens": np.diff(starts.astype(np.int64)), "ids_crc32": [zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:])]})

    out = map_batches(files.select("path", "base").repartition(parts, "path"), read, OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
