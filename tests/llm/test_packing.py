import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import op3_packing, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = [
    None, "", "one", "A's b c\x1cd it's 12 3!?", "\u00e9 e\u0301 \u0301x \u03a3\u0391\u03a3 \u0130x \u0958", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>.", " \n\t x\ty\r\nz", "\u6f22\u5b57 \U0001f600 caf\u00c9!!", "I'll don't 'S 'LL", "word, " * 30_000, "x" * 5000, "a.b,c; .,; ...x",
]


def check(rows, ids, capacity=2048):
    """Every id lies in one piece; sequences are gapless and within the capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for key, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            assert r.doc_tokens == len(ids[key])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[key][r.start : r.start + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[key])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(len(x) for x in ids.values()) / (capacity * len(by_sequence))


def test_query_over_whole_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    t = Tokenizer.from_file(PATH)
    ids = {k: [*e.ids, 1] for k, e in zip(docs.doc_id, t.encode_batch(list(docs.text), add_special_tokens=False), strict=True)}
    assert check(op3_packing(spark, sf).collect(), ids) > 0.98


def test_edge_cases(spark):
    t = Tokenizer.from_file(PATH)
    rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(TEXTS)], "doc_id bigint, text string, start int")
    got = packing.pack(rows, PATH).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    check(got, {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(TEXTS)})
    assert packing.pack(rows.limit(0), PATH).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id string, text string"), PATH)
    assert [r.doc_id for r in twice.collect()] == [None, None]


def ids_of(texts):
    own = packing.word_ids(PATH)
    return [np.frombuffer(x, "<u4").tolist() for x in own(pa.array(texts, pa.large_string()))]


def test_ids_around_every_code_point():
    """Each character before punctuation, between letters, behind a letter and alone, against the library.

    Beyond U+3000 every 41st; all of them have been compared once (4 minutes).
    """
    t = Tokenizer.from_file(PATH)
    points = [chr(c) for c in (*range(0x3000), *range(0x3000, 0x110000, 41)) if not 0xD800 <= c < 0xE000 and chr(c) not in " \n"]
    wrong = []
    for at in range(0, len(points), 4096):
        texts = [f.format(c) for c in points[at : at + 4096] for f in ("x{0}.", "{0}! a{0}b, {0}{0}?", "{0}\u0301. E{0}")]
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        wrong += [x for x, a, b in zip(texts, ids_of(texts), want, strict=True) if a != b]
        packing.word_ids(PATH).known = {"": b""}
    assert not wrong


def test_ids_of_words_that_normalise_to_marks():
    t = Tokenizer.from_file(PATH)
    r = random.Random(3)
    letters = "aZ\u00e9\u00c9\u0130\u0131\u0301\u0307\u0327\u0958\u09dc\u03a3\u1e9e\u212a\u01c4\uac00\u1100\u1161'.,!? \n\t<|>9\u00b2\u2160\u3000"
    texts = ["\u0130.", "SANAY\u0130, ticaret", "x \u0130!", *("".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(5_000))]
    assert ids_of(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing_deals_every_item_once(k):
    r = random.Random(k)
    for n in (0, 1, 2, 5, 40):
        sizes = [r.randint(1, 100) for _ in range(n)]
        sets = packing.differencing(sizes, k)
        assert sorted(i for s in sets for i in s) == list(range(n))
        assert len(sets) <= k


def test_differencing_is_near_equal():
    r = random.Random(1)
    sizes = [r.randint(1, 512) for _ in range(800)]
    sums = [sum(sizes[i] for i in s) for s in packing.differencing(sizes, 100)]
    assert max(sums) - min(sums) < 30
    assert packing.differencing([8, 7, 6, 5, 4], 2) and max(sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)) <= 16


def test_window_count_rises_with_overflow():
    sizes = [60, 60, 60]
    assert sorted(map(len, packing.windows(sizes, 100))) == [1, 1, 1]
    assert packing.windows([], 100) == []
