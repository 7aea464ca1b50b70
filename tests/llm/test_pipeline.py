import corpus_pipeline
from chronoloom.llm import quality
from chronoloom.llm.base import materialize, table
from chronoloom.llm.tokens import vocabulary_path
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_neardup import brute_keep
from tests.llm.test_tokens import checked_pieces


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]

    expected = [[r for r in rows if model.score(r[1]) >= 0.7]]
    expected.append([(d, t) for d, t, n, k in brute_lines(expected[-1], exact=1) if n == k or t.strip(" \t\r\n")])
    kept = set(brute_keep(expected[-1]))
    expected.append([r for r in expected[-1] if r[0] in kept])
    leaks = {d for _, d in brute_leaks(expected[-1], items)}
    expected.append([r for r in expected[-1] if r[0] not in leaks])
    assert len(rows) > len(expected[0]) > len(expected[-1]) > 50

    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=lambda r: r[0])
        assert [r[:2] for r in got] == want, name
        assert all(n == len(t) for _, t, n in got)

    library = Tokenizer.from_file(vocabulary_path())
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in expected[-1]}
    checked_pieces(corpus_pipeline.packing_stage(spark, docs, sf).collect(), ids, 4096)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(ids)


def test_stages_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "without an id, but long enough a text", None, None, 37), (3, "x\n" * 50, "en", "a", 100), (3, "x\n" * 50, "en", "a", 100), (4, "word " * 9000, "en", "b", 45000)]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, sequence_id string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.count()
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0
