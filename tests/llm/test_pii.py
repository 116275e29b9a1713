import hashlib
import random

import numpy as np
import re

from tessera.llm import pii
from tessera.llm.queries import op5_pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    r = random.Random(7)
    texts = ["".join(r.choice("a1.@+-( )9_%0\u00e9") for _ in range(r.randint(0, 60))) for _ in range(5000)]
    texts += ["a@b.c_d@e.f", "x@y@z.com", "4111 1111-1111 1111", "001.002.003.0255", "1.2.3.4.5.6.7.8", "+1 (988) 555-2485", "a@b", "@b.c", ""]
    assert all(pii.base_spans(t) == brute(t) for t in texts)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)


def test_added_spans_part_what_the_patterns_run_together():
    text = "call +1 (269) 555-3296 4524132264652876 now"
    assert brute(text) == []
    spans = [(text[a:b], pii.KINDS[k]) for (a, k, b), _ in pii._spans(pii.train(), [text])[0]]
    assert spans == [("+1 (269) 555-3296", "phone"), ("4524132264652876", "card")]


def test_spelled_out_addresses_are_proposed_whatever_their_case():
    for own in ("jane_42 (AT) mail (DOT) org", "jane_42 [AT] mail [dot] org", "jane_42 at mail.org", "jane_42\tat\tmail\tdot\torg", "jane_42 AT mail DOT org"):
        text = f"write to {own}, please"
        assert (9, 0, 9 + len(own)) in pii.candidates(text), own
    text = "ba tolimo jane_42 (AT) mail (DOT) org"
    assert [(text[a:b], pii.KINDS[k]) for (a, k, b), _ in pii._spans(pii.train(), [text])[0]] == [(text[10:], "email")]


def test_numbers_of_many_groups_are_proposed():
    text = "+33 (0) 1 23 45 67 89 4524132264652876"
    assert {(0, 3, 21), (22, 2, 38)} <= set(pii.candidates(text))
    text = "12 41 11 11 11 11 11 11 11 7"
    assert (3, 2, 26) in pii.candidates(text)
    text = " ".join("1" * 40)
    assert max(len(text[a:e]) for a, _, e in pii.candidates(text)) == 2 * 19 - 1


def brute_added(text):
    """Proposals one by one, best first, against all spans taken so far."""
    model, taken = pii.train(), list(pii.base_spans(text))
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
    scored = []
    for c in pii.candidates(text):
        if not any(meets(c, b) for b in taken):
            score = round(float(model.score(np.array([pii.features(text, c)]))[0]), 9)
            if score >= model.thresholds[c[1]]:
                scored.append((-score, c[0] - c[2], c))
    out = []
    for *_, c in sorted(scored):
        if not any(meets(c, b) for b in taken):
            taken.append(c)
            out.append(c)
    return sorted(out)


def test_added_spans_against_proposals_one_by_one(spark):
    r = random.Random(31)
    texts = [" ".join(pii.sentence(r)[0] for _ in range(3)) for _ in range(150)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    got = pii._spans(pii.train(), texts)
    assert [[s for s, base in own if not base] for own in got] == [brute_added(t) for t in texts]
    assert sum(not base for own in got for _, base in own) > 100


def test_look_alikes_stay():
    texts = ['token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f8b7d1"', "password=b7db7aa4a5fcc78305", "version 1.22.3.444", "order 12345678", "2024-01-02 10 1234 123", "plain words only"]
    assert pii._spans(pii.train(), texts) == [[]] * len(texts)


def test_held_out_precision_of_the_trees():
    model, r = pii.train(), random.Random(99)
    found = true = 0
    for _ in range(300):
        text, spans = pii.sentence(r)
        for own, base in pii._spans(model, [text])[0]:
            if not base:
                found += 1
                true += own in spans
    assert found > 20
    assert true / found > 0.95


def test_redaction_and_edge_cases(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "mail a.b@c.de, +1 (988) 555-2485", 0), (4, "1" * 200_000 + "a@" * 20_000, 0), (3, "mail a.b@c.de, +1 (988) 555-2485", 0)], "doc_id bigint, text string, PII int")
    got = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert got[1] is None
    assert got[2] == ""
    assert got[3] == "mail [email], [phone]"
    assert pii.find(rows).count() == 5
    assert pii.find(rows.limit(0)).count() == 0
    spans = pii.find(rows).where("doc_id = 3").first().pii
    assert [(s.kind, s.start, s.end, s.base) for s in spans] == [("email", 5, 13, True), ("phone", 15, 32, True)]
