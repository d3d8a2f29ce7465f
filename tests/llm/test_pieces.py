"""The chunk table against the library on whole texts."""

import hashlib
import random

import pytest
import sentencepiece

from foliometry.llm import pieces

SCHEMA = "doc_id long, text string, ids int, decoded string, key string, n_tokens int"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())


def random_texts(n):
    rng = random.Random(11)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "the", "\t", "😀", "　", "<s>", "</s>", "1", "ﬁ", " of", "\x00", "​", "ing "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def expected(model, text):
    ids = model.encode(text or "", add_eos=True)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids))


def test_equals_the_library_on_odd_texts(spark, model):
    texts = [None, "", " ", "a ", " a", "▁", "▁▁", "a▁", "x" * 70_000, "word " * 30_000, "é" * 399, "same", "same", *random_texts(3000)]
    ids = [None, *range(1, 12), 11, *range(13, len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in pieces.digests(docs.repartition(5)).collect())
    want = sorted((-1 if i is None else i, *expected(model, t)) for i, t in zip(ids, texts, strict=True))
    assert got == want


def test_ids_and_texts_are_returned_and_a_full_table_is_begun_anew(spark, model):
    texts = [f"word{i} thing{i % 7} 的{i}" for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for most in (1, 40, pieces.TABLE_CHUNKS):
        got = {r["doc_id"]: r for r in pieces.encoded(docs, most=most).collect()}
        assert all(got[i]["ids"] == model.encode(t, add_eos=True) and got[i]["decoded"] == t for i, t in enumerate(texts))


def test_each_distinct_chunk_is_segmented_once(model):
    class Counting:
        eos_id, piece_to_id, decode = model.eos_id, model.piece_to_id, model.decode
        seen: list = []

        def encode(self, texts, num_threads):
            self.seen += texts
            return model.encode(texts, num_threads=num_threads)

    import pyarrow as pa

    table = pieces.ChunkTable(Counting())
    for text in ("one two  three two", "two one", "three two one  three"):
        pieces.gathered(table, *pieces.clean_bytes(pa.array([text])))
    # a key is what follows the first marker: a text's first word has none before it
    assert sorted(table.model.seen) == [" three", "one", "three", "two"]


def test_bytes_that_are_no_utf8_and_empty_tables(spark, model):
    bad = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF2062') AS STRING) AS text")
    assert [r["ids"] for r in pieces.encoded(bad).collect()] == [model.encode("a� b", add_eos=True)]
    none = spark.createDataFrame([], SCHEMA)
    assert pieces.digests(none).collect() == []


def test_a_model_whose_pieces_cross_markers_is_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            pass

        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross"):
        pieces.load("any")
