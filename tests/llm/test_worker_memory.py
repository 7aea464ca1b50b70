import gc
import tracemalloc

import pyarrow as pa

from chronoloom.llm import decontaminate, neardup, packing, quality
from chronoloom.llm.base import WordHashes, table
from chronoloom.llm.tokens import ChunkEncoder, vocabulary_path

SF = "/root/testdata/sf0.001"
#: More tasks than there are workers; idle ones take turns, so each is reached.
TASKS = 16


def held(spark):
    """Words and chunks that Spark's Python workers still remember."""

    def run(batches):
        for b in batches:
            words = sum(len(o) for o in gc.get_objects() if isinstance(o, WordHashes))
            chunks = sum(len(o.known) for o in gc.get_objects() if isinstance(o, ChunkEncoder))
            yield pa.RecordBatch.from_pydict({"words": [words], "chunks": [chunks]})

    rows = spark.range(TASKS * 4).repartition(TASKS).mapInArrow(run, "words long, chunks long").collect()
    return max(r.words for r in rows), max(r.chunks for r in rows)


def test_workers_hold_one_operators_memory(spark):
    docs = table(spark, SF, "documents").repartition(TASKS)
    model = quality.fit(docs, table(spark, SF, "labels"), updates=500)
    pack = lambda: packing.pack(docs, vocabulary_path()).write.format("noop").mode("overwrite").save()
    benchmark = table(spark, SF, "benchmark")
    steps = [lambda: quality.score(docs, model), lambda: quality.keep_good(docs, model), lambda: neardup.keep_one(docs), lambda: decontaminate.find(docs, benchmark), lambda: decontaminate.drop_contaminated(docs, benchmark)]
    for step in steps:
        pack()
        words, chunks = held(spark)
        assert words == 0 and chunks > 100  # an encoder's own memory stays for its later tasks
        step().write.format("noop").mode("overwrite").save()
        assert held(spark) == (0, 0)


def test_training_rows_take_eight_bytes_a_feature():
    rows, texts = 40_000, [f"w{i % 97} v{i % 89}" for i in range(1000)]

    def peak(n):
        tracemalloc.start()
        quality.train(((texts[i % 1000], i % 2) for i in range(n)), updates=1)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    base = peak(1)
    assert peak(rows) - base < rows * (3 * 8 + 64)
