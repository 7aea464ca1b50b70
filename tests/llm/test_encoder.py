import shutil

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from chronoloom.llm import packing
from chronoloom.llm.tokens import ChunkEncoder, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(vocabulary_path())


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def test_a_word_is_learnt_once_whatever_sign_follows(library):
    own, text = ChunkEncoder(vocabulary_path()), "Quoblich, quoblich. quoblich\nétäßig, étäßig. étäßig"
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids
    assert set(own.known) == {"", ",", ".", "quoblich", "étäßig"}


def test_first_chunks_outlive_a_full_memory():
    own = ChunkEncoder(vocabulary_path(), most=200)
    common, rare = [f"c{chr(97 + i)}" for i in range(26)], [f"r{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    for _ in range(3):
        own.encode([" ".join(common)])
        own.encode([" ".join(rare)])
        own.encode(["x"])
        assert set(common) < set(own.known) and len(own.known) <= 200


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBs1é½ªµœ×\x85\xa0 \t\n.,,.!'\"<|İ\u0301Σ"), max_size=40))
@example("it's, 'S. x!, y.. z,, . , 1. ½, ª. œ, \u00a0, \t. end.")
def test_commas_and_full_stops_after_anything(library, encoder, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_rows_keep_their_order(library, encoder):
    texts = [None, "", "a, b. " * 50_000, "last, one.", None, ("x" * 100 + ", y. ") * 20]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.encode([]) == [] and not encoder.known.long


def test_packing_learns_a_word_once(spark, tmp_path):
    path = str(shutil.copy(vocabulary_path(), tmp_path / "own.json"))  # workers' encoders of other tests aren't met
    docs = spark.createDataFrame([(i, "Quoblich, quoblich. quoblich") for i in range(16)], "doc_id long, text string").repartition(4)
    packing.pack(docs, path).write.format("noop").mode("overwrite").save()

    def run(batches):
        from chronoloom.llm.base import _REMEMBERED

        for _ in batches:
            encoder = _REMEMBERED.get(("chunks", path))
            yield pa.RecordBatch.from_pydict({"chunks": [sorted(encoder.known) if encoder else None]})

    rows = spark.range(64).repartition(16).mapInArrow(run, "chunks array<string>").collect()
    assert {tuple(r.chunks) for r in rows if r.chunks} == {("", ",", ".", "quoblich")}
