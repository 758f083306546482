import hashlib
import random

import numpy as np
import pytest

from cantata.llm import bpe
from cantata.llm.queries import vocabulary_path

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(vocabulary_path()))


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_same_ids_as_the_library(codec, reference):
    rng = random.Random(1)
    alphabet = " \n\t 　 '''stmdrevl  aZé9٣½#!,\U0001f600中́\r\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", "a" * 3000, "'" * 700, " " * 1000, "ab" * 1500, "it's we'll they'RE 's", "  's\n's", "<|endoftext|>"]
    for t, ids in zip(texts, codec.encode_many(*buffers(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        ids = np.frombuffer(ids, "<u4").astype(np.int32)
        assert codec.decode(ids, codec.offsets(ids)) == t.encode()


def test_long_pieces_merge_the_same(codec):
    rng = random.Random(2)
    for _ in range(50):
        piece = "".join(rng.choice("abet ion") for _ in range(300)).encode()
        n, bpe.LONG_PIECE = bpe.LONG_PIECE, 10**9
        try:
            short = bpe.merge(piece, codec.ranks.get)
        finally:
            bpe.LONG_PIECE = n
        assert bpe.merge_long(piece, codec.ranks.get) == short


def test_tables(spark, reference):
    rows = [(1, "Hello  world", "a"), (2, None, "b"), (3, "", None), (None, "x\n\ny", "c"), (1, "Hello  world", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, vocabulary_path(), digests=True).collect()
    for r, (_, text, _) in zip(out, rows):
        ids = reference.encode_ordinary(text or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert list(r.offsets) == [len(b"".join(reference.decode_single_token_bytes(t) for t in ids[:k])) for k in range(len(ids) + 1)]
    back = bpe.decode(bpe.encode(df, vocabulary_path()), vocabulary_path()).collect()
    assert [r.text for r in back] == [t or "" for _, t, _ in rows]
    assert bpe.encode(df.where("false"), vocabulary_path()).count() == 0


def test_bytes_that_are_no_utf8(spark, reference):
    raw = [b"ok \xff\xfe x", b"\xe4\xb8", b"plain", b"", b"\x80abc\xc3"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text").coalesce(1)
    want = [x.decode("utf-8", "replace") for x in raw]
    out = bpe.encode(df, vocabulary_path(), digests=True).orderBy("doc_id").collect()
    assert [list(r.ids) for r in out] == [reference.encode_ordinary(t) for t in want]
    assert [r.decoded_sha256 for r in out] == [hashlib.sha256(t.encode()).hexdigest() for t in want]


def test_long_text(spark, reference):
    text = "It's 12 naïve words,\n" * 40_000
    r = bpe.encode(spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string"), vocabulary_path()).where("doc_id = 1").first()
    assert list(r.ids) == reference.encode_ordinary(text) and r.offsets[-1] == len(text.encode())
