import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnmem.llm import pii
from cairnmem.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def plain(text):
    """The base kinds by the plain patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s[:3] for s in pii.find_spans(text) if s[3]]


def test_against_plain_patterns(texts):
    assert sum(len(plain(t)) for _, t in texts) > 5
    for _, t in texts:
        assert base(t) == plain(t)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.-+ 0_%é(\n4", max_size=60))
def test_any_text(t):
    assert base(t) == plain(t)


@pytest.mark.parametrize("t", ["a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (234) 567-8901.", "0255.1.1.1", "10255.1.1.1", "x@y.z@q.w", "a@b..c"])
def test_edges(t):
    assert base(t) == plain(t)


def test_further_kinds_need_checks_or_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert "iban" in kinds("pay to GB82 WEST 1234 5698 7654 32 now") and "iban" not in kinds("GB82 WEST 1234 5698 7654 33")
    assert "short_card" in kinds("amex card 378282246310005") and "short_card" not in kinds("number 378282246310005")
    assert "national_id" in kinds("my SSN is 123-45-6789") and "national_id" not in kinds("part 123-45-6789")


def test_long_runs_are_linear():
    began = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "1 " * 150_000):
        pii.find_spans(t)
    assert time.time() - began < 20


def test_query(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op5_pii"](spark, sf_dir).collect()}
    for i, t in texts:
        found = plain(t)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in found) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(rows[i]["spans"].split(",")) | {""}


def test_odd_and_empty(odd, empty):
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0
    assert pii.redact("mail a@b.co now") == "mail [email] now"
