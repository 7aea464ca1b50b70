import random
import zlib

import pytest

from chronoloom.llm import editcounts
from chronoloom.llm.queries import made_edits, op6_token_counts
from chronoloom.llm.tokens import ChunkEncoder, vocabulary_path


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)


def apply(text, edits):
    for at, delete, insert in edits:
        at = max(0, min(at or 0, len(text)))
        text = text[:at] + (insert or "") + text[max(at, at + (delete or 0)) :]
    return text


def test_random_edits_equal_whole_encodings(encode):
    rng = random.Random(2)
    own = ChunkEncoder(vocabulary_path())
    count = lambda pieces: [len(b) // 4 for b in own.encode(pieces)]
    spaced = [" ", "\n", "word", "It's", "é", "́", "1", "<|endoftext|>", "abc" * 40, "\t", "."]
    solid = ["word", "It's", "'", "s", "-'", "H̱", "́", "1", "23", "<|endoftext|>", "<", "|", ">", "abc" * 30, ".", "a,b", "日本。", "は̀", "か゛が", "가́", "=", "̸", "Σ"]
    for k in range(200):
        parts = solid if k % 2 else spaced
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 400)))
        tree = editcounts.Tree(count, text)
        assert tree.tokens == encode(text)
        for _ in range(8):
            at, delete, insert = rng.randrange(0, len(text) + 3), rng.choice([0, 0, 1, 5, 200]), "".join(rng.choice(parts) for _ in range(rng.randrange(4)))
            if rng.random() < 0.5:  # as if read from a table
                tree = editcounts.Tree(count, text, tree.stored())
                made = tree.encoded
                assert made == 0 and tree.tokens == encode(text)
            tree.edit(at, delete, insert)
            text = apply(text, [(at, delete, insert)])
            assert tree.text() == text and tree.characters == len(text) and tree.tokens == encode(text)


def test_an_edit_touches_few_leaves(encode):
    own = ChunkEncoder(vocabulary_path())
    text = "some words in a long text " * 20000
    tree = editcounts.Tree(lambda p: [len(b) // 4 for b in own.encode(p)], text)
    made = tree.encoded
    for at in range(0, 500_000, 5_000):
        tree.edit(at, 2, "xy z")
    assert tree.encoded - made <= 400 < made


def test_texts_without_spaces_have_many_leaves(encode):
    text = "key=value;list[12345].name,日本語。テスト" * 500
    own = ChunkEncoder(vocabulary_path())
    tree = editcounts.Tree(lambda p: [len(b) // 4 for b in own.encode(p)], text)
    made = tree.encoded
    assert made > len(text) / 130
    for at in range(0, len(text), 997):
        tree.edit(at, 1, "x")
    assert tree.encoded - made <= 4 * (len(text) // 997 + 1) and tree.tokens == encode(tree.text())


def test_query_against_whole_encodings(spark, encode):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("edits", made_edits()).collect()}
    got = op6_token_counts(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id].text or ""
        after = apply(text, [(e["at"], e["delete"], e["insert"]) for e in rows[r.doc_id].edits])
        assert (r.n_tokens, r.n_tokens_after, r.n_edits, r.n_chars_after, r.text_after_crc32) == (encode(text), encode(after), 4, len(after), zlib.crc32(after.encode()))
    assert sum(r.leaves_encoded for r in got) < 0.5 * sum(r.n_leaves for r in got)


def test_edited_trees_are_stored_and_edited_again(spark, encode, tmp_path):
    docs = [(1, "one two three " * 40), (2, None), (3, ""), (4, "word " * 30000), (None, "no id"), (5, "same"), (5, "same")]
    first = [(1, 2, 3, 1, "!"), (1, 1, 0, 0, "zero "), (2, 1, 7, 9, "made"), (3, 1, None, None, None), (4, 1, 75_000, 10, "inside"), (5, 1, -4, 1, "x"), (99, 1, 0, 0, "lost"), (None, 1, 0, 0, "lost")]
    second = [(1, 1, 100, 50, ""), (4, 9, 149_990, 100, "tail"), (5, 1, 99, 0, "́")]
    df = spark.createDataFrame([(*d, "c", "d") for d in docs], "doc_id long, text string, edits string, leaf_chars string")
    log = lambda rows: spark.createDataFrame(rows, "doc_id long, seq int, at long, delete long, insert string")
    editcounts.trees(df, vocabulary_path()).write.parquet(str(tmp_path / "0"))
    texts = {d: t or "" for d, t in docs}
    for k, edits in enumerate((first, second)):
        stored = spark.read.parquet(str(tmp_path / str(k)))
        editcounts.edit(editcounts.attach_edits(stored, log(edits)), vocabulary_path()).write.parquet(str(tmp_path / str(k + 1)))
        texts = {d: apply(t, [e[2:] for e in sorted((e for e in edits if e[0] == d and d is not None), key=lambda e: e[1])]) for d, t in texts.items()}
        got = spark.read.parquet(str(tmp_path / str(k + 1))).collect()
        assert sorted((str(r.doc_id), r.text, r.n_tokens, sum(r.leaf_tokens)) for r in got) == sorted((str(d), texts[d], encode(texts[d]), encode(texts[d])) for d, _ in docs)
        long = next(r for r in got if r.doc_id == 4)
        assert long.leaves_encoded <= 4 < long.n_leaves
    with pytest.raises(ValueError):
        editcounts.Tree(len, "text", ([3], [1]))


def test_attached_edits_and_odd_rows(spark, encode):
    docs = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 30000), (None, "no id"), (5, "same"), (5, "same")]
    edits = [(1, 2, 3, 1, "!"), (1, 1, 0, 0, "zero "), (2, 1, 7, 9, "made"), (3, 1, None, None, None), (4, 1, 75_000, 10, "inside"), (5, 1, -4, 1, "x"), (99, 1, 0, 0, "lost"), (None, 1, 0, 0, "lost")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, edits string")
    log = spark.createDataFrame(edits, "doc_id long, seq int, at long, delete long, insert string")
    got = editcounts.counts(df, vocabulary_path(), log).collect()
    assert len(got) == len(docs)
    for r in got:
        before = next(t for d, t in docs if d == r.doc_id) or ""
        after = apply(before, [e[2:] for e in sorted((e for e in edits if e[0] == r.doc_id and r.doc_id is not None), key=lambda e: e[1])])
        assert (r.n_tokens_before, r.n_tokens, r.n_chars, r.text_crc32) == (encode(before), encode(after), len(after), zlib.crc32(after.encode()))
    assert editcounts.counts(df.limit(0), vocabulary_path(), log).count() == 0
    assert editcounts.counts(df, vocabulary_path(), log.limit(0)).where("n_edits > 0").count() == 0
