import base64
import hashlib
import random

import pytest
import tiktoken
from public_tokenizers import PATTERN

from tessera.llm import bpe
from tessera.llm.queries import op9_bpe, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd():
    r = random.Random(2)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    return [
        "", "\x00", "a" * 5000, "ab" * 700, "x" * 511, "x" * 512, "x" * 513, " " * 1000 + "x", "the" * 400, "\U0001f600" * 300, "it's we'll  \n\n end\u3000",
        pick("abcd\u00e9\u6f22 \n\t!?'", 3000), pick("abcdefghijklmnop", 2000), pick("abc", 400), "\ud7ff\ue000",
    ]


def test_same_ids_as_the_library(known):
    own = bpe.Encoder(PATH, PATTERN)
    assert [x.tolist() for x in own.batch(odd())] == [known.encode_ordinary(x) for x in odd()]


def test_memory_of_pretokens_is_bounded(known, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    own = bpe.Encoder(PATH, PATTERN)
    texts = [f"number{i} of words{i * 7}" for i in range(40)]
    for t in texts:
        assert own.batch([t])[0].tolist() == known.encode_ordinary(t)
        assert len(own.known) <= 20


def test_every_token_decodes():
    ranks = bpe.ranks(PATH)
    import numpy as np

    assert all(ranks.decode(np.array([i])) == t for i, t in ranks.tokens.items())


def test_query(spark, known):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_of_arrays(spark):
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*odd()[:-1], None])], "doc_id bigint, text string, IDS int")
    out = bpe.decode(bpe.encode(rows, PATH, PATTERN), PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out)
    assert bpe.encode(rows.limit(0), PATH, PATTERN).count() == 0


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([("ab cd", 1, 2, 3)], "`the text` string, _bpe int, N_TOKENS int, ids_sha256 int")
    out = bpe.round_trip(docs, PATH, PATTERN, text="the text")
    assert [(r._bpe, r.n_tokens) for r in out.collect()] == [(1, 2)]
    assert sorted(c.lower() for c in out.columns) == ["_bpe", "decoded_sha256", "ids_sha256", "n_tokens", "the text"]
