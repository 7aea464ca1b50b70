"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batch, map_batches
from .tokens import END_ID, ChunkEncoder

#: Ids that are packed together: bounds a task's memory, about 250 to 1,000 sequences.
GROUP_IDS = 2_000_000
#: How far a full sequence's cost may lie above the mean because of one long piece.
SLACK = 0.1
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
_OUT = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("sequence_cost", pa.float64())])


def _pieces(n: int, longest: int) -> list[int]:
    """n ids in as few pieces of at most ``longest`` as can be, alike to one id."""
    k = -(-n // longest)
    return [n // k + (i < n % k) for i in range(k)]


def longest_piece(lengths: list[int], most: int, linear: float, quadratic: float, slack: float = SLACK) -> int:
    """The largest of ``most``, its half, its quarter ... at which a full sequence with such a piece costs at most
    1 + ``slack`` times the mean full sequence, all documents being cut into pieces of at most that length."""
    size, sequences = most, max(1.0, sum(lengths) / most)
    while size > 1:
        mean = linear * most + quadratic * sum(x * x for n in lengths for x in (_pieces(n, size) if n > size else (n,))) / sequences
        if linear * most + quadratic * size * size <= (1 + slack) * mean:
            break
        size //= 2
    return size


def plan(lengths: list[int], most: int, linear: float = 1.0, quadratic: float | None = None, slack: float = SLACK) -> list[tuple[int, int, int, int]]:
    """Pack documents of these lengths; returns (document, start, length, sequence) in each sequence's order.

    The sequences' capacities sum to exactly the tokens there are: as many of ``most`` as fit, then powers of two.
    Documents longer than ``longest_piece`` are cut into equal pieces, so that the long ones share sequences with
    others instead of making them dearer. All pieces go in descending order to the sequence of lowest cost so far
    (linear plus quadratic in a piece's length, as attention within a piece is) that has room; one that fits nowhere
    fills the roomiest and goes on with its remainder.
    """
    quadratic = 1.0 / most if quadratic is None else quadratic
    longest = longest_piece(lengths, most, linear, quadratic, slack)
    rest, pieces, total = [], [], sum(lengths)
    for doc, n in enumerate(lengths):
        at = 0
        for size in _pieces(n, longest) if n > longest else (n,):
            rest.append((-size, doc, at))
            at += size
    room = [most] * (total // most) + [1 << b for b in reversed(range((total % most).bit_length())) if total % most >> b & 1]
    space, cost = np.array(room, np.int64), np.zeros(len(room))
    heapq.heapify(rest)
    while rest:
        n, doc, at = heapq.heappop(rest)
        n = -n
        fits = np.flatnonzero(space >= n)
        s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(space))
        take = min(n, int(space[s]))
        pieces.append((doc, at, take, s))
        space[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(rest, (-(n - take), doc, at + take))
    return pieces


def pack(docs: DataFrame, vocabulary: str, *, most: int = 4096, end_id: int = END_ID, group_ids: int = GROUP_IDS) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``most`` ids; one row per piece.

    Rows are packed where they are read, in groups of at least ``group_ids`` ids: no shuffle, bounded memory, and
    padding is none within a group, whose last sequences are powers of two; costs are balanced within a group, and
    ``sequence_cost`` (tokens plus the sum of squared piece lengths over ``most``) says how well. A document longer than
    a group only makes that group longer; texts of any length are packed whole. Null text: only the end id; null doc_id: kept, null; equal doc_ids and repeated rows:
    packed each on its own; empty table: no rows; other columns are ignored. sequence_id is unique over the
    result; a task that runs again gives the same ids if its input is a stored table.
    """
    if most < 1 or group_ids < 1:
        raise ValueError("most and group_ids must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, tail = ChunkEncoder.shared(vocabulary), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, sequence
            pieces = plan([len(b) // 4 for _, b in held], most)
            filled: dict[int, int] = {}
            cost: dict[int, float] = {}
            for _, _, length, s in pieces:
                cost[s] = cost.get(s, 0.0) + length + length * length / most
            rows: list[tuple] = []
            for doc, at, length, s in pieces:
                key, ids = held[doc]
                offset = filled.get(s, 0)
                filled[s] = offset + length
                rows.append((key, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), len(ids) // 4, sequence + s, offset, cost[s]))
            sequence += len(filled)
            held, n = [], 0
            for at in range(0, len(rows), 10_000):
                yield batch(_OUT, dict(zip(_OUT.names, map(list, zip(*rows[at : at + 10_000])))))

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                held.append((doc, ids + tail))
                n += len(ids) // 4 + 1
                if n >= group_ids:
                    yield from flush()
        if held:
            yield from flush()

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, OUT)
