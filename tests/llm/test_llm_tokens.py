import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from corpus import SCHEMA, awkward, table, texts
from tokenizers import Tokenizer

from hoopframe.llm import bpe, catalog, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, most):
    rng = random.Random(3)
    parts = ["a", "é", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "the", "'s", "'ll", "12345", "###", "日本", "😀", "<|endoftext|>", "\t", "zq"]
    return ["".join(rng.choices(parts, k=rng.randint(0, most))) for _ in range(n)]


def test_ids_equal_the_library(library):
    coder = bpe.Encoder(RANKS, P.PATTERN)
    items = odd_texts(400, 60) + ["x" * 5000 + "abcthe" * 700, "ab" * 1200]
    ids, cuts = coder.encode(items)
    for i, t in enumerate(items):
        assert ids[cuts[i]:cuts[i + 1]].tolist() == library.encode_ordinary(t)


def test_round_trip(spark, library):
    docs = awkward(spark)
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(bytes(r.bytes) for r in out) == sorted((r.text or "").encode() for r in docs.collect())
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(bytes(r.bytes).decode())


def test_counts_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(JSON)
    docs = awkward(spark)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    out = token_counts.count_tokens(docs, JSON).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)


def test_chunks_resynchronise():
    tokenizer = Tokenizer.from_file(JSON)
    for t in odd_texts(300, 80) + ["word " * 500, "x" * 400, " " * 300, "a b" * 200]:
        want = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert token_counts.count_chunks(t, tokenizer, 20, 4) == want
        assert token_counts.Counter(JSON, huge=50).count([t]) == [want]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.library(P.path("word_bpe_49k.json"))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.decode(bpe.encode(none, RANKS, P.PATTERN), RANKS).count() == 0
    assert token_counts.count_tokens(none, JSON).count() == 0


def test_op1_query(spark, library, tmp_path):
    items = texts(5, 20)
    table(spark, items).write.parquet(str(tmp_path / "documents.parquet"))
    for r in catalog.QUERIES["op1_byte_bpe"](spark, str(tmp_path)).collect():
        t = items[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
