"""Byte-level BPE against the tiktoken library, and the round trip."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from fleetlens.llm import bpe, catalog

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def samples():
    rng = random.Random(4)
    alphabet = "abcdeéñß  \n\t.,!'s123文字🙂  "
    out = ["", " ", "  \n ", "a", "don't I'll", "x" * 300, "ab" * 5000, "<|endoftext|>", " " * 999, "1" * 77, "　あ" * 40]
    return out + ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 3, 5, 8, 20, 100, 500, 3000) for _ in range(5)]


def test_ids_equal_tiktoken(theirs):
    encoder = bpe.Encoder(PATH, PATTERN)
    for text in samples() * 2:
        assert encoder(text) == theirs.encode_ordinary(text)


def test_a_long_piece_is_not_quadratic():
    """One piece of 200,000 bytes; the round trip is exact."""
    rng = random.Random(1)
    piece = "".join(rng.choice("abcde") for _ in range(200_000)).encode()
    ranks = bpe.load_ranks(PATH)
    token = {i: t for t, i in ranks.items()}
    ids = bpe.merge(piece, ranks)
    assert b"".join(token[i] for i in ids) == piece and len(ids) < 150_000


def test_columns_nulls_and_slices(spark, theirs, monkeypatch):
    rows = [(i, t, "k", b"z") for i, t in enumerate([*samples(), None, "same", "same"])] + [(None, "no id", "k", b"z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary")
    for keep in (None, ("doc_id",)):
        got = bpe.decode(bpe.encode(docs, PATH, PATTERN, keep=keep), PATH)
        assert got.columns == (["doc_id", "text", "ids", "decoded"] if keep is None else ["doc_id", "ids", "decoded"])
        found = {r.doc_id: r for r in got.collect()}
        assert len(found) == len(rows)
        for i, t, *_ in rows:
            assert list(found[i].ids) == theirs.encode_ordinary(t or "") and found[i].decoded == (t or "").encode()
    batch = bpe.pa.RecordBatch.from_arrays([bpe.pa.array(range(5))], ["a"])
    parts = [p.column(0).to_pylist() for p in bpe._groups(batch, [2, 1, 4, 0, 1], 3)]
    assert parts == [[0, 1], [2], [3, 4]]


def test_many_pieces_at_once(theirs, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeéñthingouan") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(300)]
    monkeypatch.setattr(bpe, "KEPT_PIECES", 500)
    encoder = bpe.Encoder(PATH, PATTERN)
    for lo in range(0, 300, 30):
        assert [x.tolist() for x in encoder.encode(texts[lo:lo + 30])] == [theirs.encode_ordinary(t) for t in texts[lo:lo + 30]]


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_query_equals_tiktoken(spark, theirs):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in catalog.QUERIES["op7_byte_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = theirs.encode_ordinary(r.text or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), sha)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
