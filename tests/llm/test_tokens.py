import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import dac, packing, queries
from chronoloom.llm.tokens import ChunkEncoder, vocabulary_path

ODD = [None, "", " ", "\n\n", "a\tb\x0bc\u2003d\u00a0e", "It's  we'LL <|endoftext|>x <|startoftext|> y", "e\u0301 \u0301x İSTANBUL ſ K", "x" * 5000 + " " + "é" * 300, "\u0000 12345 ½ \U0001f600\u200d\U0001f600", "x\x1cy\x85z"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_chunks_give_the_ids_of_whole_texts(library):
    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    own = ChunkEncoder(vocabulary_path(), most=500)
    for at in range(0, len(texts), 7):
        for t, ids in zip(texts[at : at + 7], own.encode(texts[at : at + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == whole(library, t)[:-1], t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=40))
def test_chunks_of_any_latin_text(text):
    test_chunks_of_any_text.hypothesis.inner_test(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB '\n\t.é\u0301\u00a0\u20031<|>"), max_size=60))
def test_chunks_of_any_text(text):
    from tokenizers import Tokenizer

    global _library
    _library = globals().get("_library") or (Tokenizer.from_file(vocabulary_path()), ChunkEncoder(vocabulary_path()))
    assert np.frombuffer(_library[1].encode([text])[0], "<u4").tolist() == _library[0].encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("HJTWYaAEIO\u0331\u030c\u0308\u030a\u0342\u0345\u0327ΑΩΣυωςσἈİıẞſ\u212a\u212b \n.'<=123각\u1112\u1161\u11a8ǅ\u1c89\ua7cb"), max_size=30))
def test_capitals_compose_before_they_are_lowered(text):
    test_chunks_of_any_text.hypothesis.inner_test(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40), max_size=30))
def test_dac_round_trip(docs):
    ids = np.array([i for d in docs for i in d], "<u4")
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    f = dac.DacFile.of(dac.encode(ids, np.arange(len(docs)), starts))
    assert f.all().tolist() == ids.tolist()
    assert [f[i] for i in range(len(ids))] == ids.tolist()
    assert f.documents()[1].tolist() == starts.tolist()


def test_dac_random_access_over_many_blocks():
    ids = np.random.default_rng(1).integers(0, 49408, 20_000).astype("<u4")
    f = dac.DacFile.of(dac.encode(ids, np.array([7]), np.array([0, len(ids)])))
    assert all(f[i] == ids[i] for i in range(0, len(ids), 37))
    with pytest.raises(IndexError):
        f[len(ids)]


def docs_with_odd_rows(spark):
    rows = [(i + 100, t, "x", 1) for i, t in enumerate(ODD)] + [(3, "same text here", "x", 1)] * 3 + [(None, "no id", None, None), (5, "long " * 3000, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, sequence_id long"), [(r[0], r[1]) for r in rows]


def test_token_files(spark, library):
    docs, rows = docs_with_odd_rows(spark)
    got = dac.read_ids(dac.write_ids(docs, vocabulary_path(), file_ids=1000)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    expected = sorted((str(d), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in ((d, whole(library, t)) for d, t in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == expected
    assert dac.read_ids(dac.write_ids(docs.limit(0), vocabulary_path())).count() == 0


def test_files_stay_at_a_given_path(spark, tmp_path, library):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    dac.write_ids(docs, vocabulary_path(), path=str(tmp_path / "ids"), file_ids=20)
    manifest = dac.open_ids(spark, str(tmp_path / "ids"))
    files = {r.path for r in manifest.collect()}
    assert len(files) > 4 and all((tmp_path / "ids" / f.rsplit("/", 1)[1]).exists() for f in files)
    one = min(files)
    stored = dac.DacFile.of((tmp_path / "ids" / one.rsplit("/", 1)[1]).read_bytes())
    assert stored[0] == whole(library, f"text {stored.documents()[0][0]}")[0]
    assert [r.doc_id for r in dac.read_ids(manifest).orderBy("start").collect()] == list(range(40))


def test_query_writes_whole_encodings(spark, library):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").sort_by("doc_id")
    at, expected = 0, []
    for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
        ids = whole(library, t)
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op2_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_fills_sequences(lengths):
    pieces = packing.plan(lengths, 16)
    assert sum(p[2] for p in pieces) == sum(lengths)
    by_doc, by_sequence = {}, {}
    for doc, at, n, s in pieces:
        by_doc.setdefault(doc, []).append((at, n))
        by_sequence[s] = by_sequence.get(s, 0) + n
    for doc, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[doc]
    assert all(n == 16 or n & (n - 1) == 0 for n in by_sequence.values())
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def full_costs(lengths):
    cost, used = {}, {}
    for _, _, n, s in packing.plan(lengths, 4096):
        cost[s], used[s] = cost.get(s, 0) + n + n * n / 4096, used.get(s, 0) + n
    return sorted(c for s, c in cost.items() if used[s] == 4096)


def test_plan_balances_cost(library):
    full = full_costs([800] * 100 + [50] * 1600)
    assert full[-1] < 1.15 * full[0]
    # long documents take part: whole sequences of one piece would cost 8192
    full = full_costs([49_000, 20_000, 9_000] + [600] * 300)
    assert full[-1] < 1.1 * full[len(full) // 2]
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    full = full_costs([len(whole(library, t)) for t in texts])
    assert full[-1] < 1.1 * full[len(full) // 2]
    # if (nearly) all is long, whole sequences are balanced as they are
    assert set(full_costs([4096 * 5] * 10)) == {8192.0}


def checked_pieces(rows, ids, most):
    """Each document's pieces cover its ids once, in sequences without gaps; ids: doc_id -> ids (distinct doc_ids)."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[d])) and r.length > 0
            assert zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= most


def test_packing_query(spark, library):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    ids = {d: whole(library, t) for d, t in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())}
    got = queries.op5_packing(spark, "/root/testdata/sf0.001").collect()
    checked_pieces(got, ids, 4096)
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(n & (n - 1) != 0 for n in used.values()) == 0  # 4096, or a smaller power of two: no padding


def test_pack(spark, library):
    docs, rows = docs_with_odd_rows(spark)
    got = packing.pack(docs, vocabulary_path(), most=64, group_ids=500).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    used = sum(n for parts in by_sequence.values() for _, n in parts)
    assert used == sum(len(whole(library, t)) for _, t in rows)
    expected = {}
    for key, t in rows:
        expected.setdefault(key, []).append(whole(library, t))
    for r in got:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in expected[r.doc_id])
    assert packing.pack(docs.limit(0), vocabulary_path()).count() == 0
