"""Personal data: patterns propose, checksums confirm, context adjusts.

Patterns propose spans of each kind, leftmost and without overlap within the kind.  Validators drop
those that cannot be real (Luhn for card numbers, mod-97 for bank account numbers, ranges for
addresses and digit counts for telephone numbers).  A span's score is its kind's prior, raised by a
word near it that names such data.  The base kinds (email, ip, card, phone) stay whatever their
score; the further kinds stay from ``MIN_SCORE`` on, so the weak ones need a word of context.

Patterns are anchored at the start of a run of characters or at a rare character, so that the time
is linear in the text, also for very long runs.  The operator only maps: no shuffle.

Nulls and ties: a null or empty text has no spans; a null doc_id stays null; repeated rows give
repeated results; an empty table gives none.  Very long texts are searched whole, in linear time.  Positions
are code points, the end exclusive.  Words of context are English; in other languages the prior alone counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmem.llm.staging import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "short_card", "national_id")
MIN_SCORE = 0.5
#: Characters before and after a span in which words of context count.
NEAR = (48, 24)
CONTEXT_BONUS = 0.35

_LOCAL = r"[A-Za-z0-9._%+-]"
_AFTER_LOCAL = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_AFTER_LOCAL}")
_EMAIL_HERE = re.compile(rf"{_LOCAL}++{_AFTER_LOCAL}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Kind: score without context, and words that name it.
PRIORS = {
    "email": (0.9, r"mail|contact|write|address"),
    "ip": (0.6, r"\bip\b|host|server|address"),
    "card": (0.8, r"card|visa|credit|pay"),
    "phone": (0.6, r"phone|call|tel|mobile|fax"),
    "iban": (0.8, r"iban|bank|account"),
    "short_card": (0.3, r"card|visa|amex|credit|pay"),
    "national_id": (0.3, r"\bssn\b|social|security|tax|identity"),
}
_CONTEXT = {kind: re.compile(words, re.IGNORECASE | re.ASCII) for kind, (_, words) in PRIORS.items()}


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check.

    >>> luhn("4111111111111111"), luhn("4111111111111112")
    (True, False)
    """
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an international bank account number, without spaces, passes its check.

    >>> mod_97("GB82WEST12345698765432")
    True
    """
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # Just after a match the run may go on; elsewhere only the start of a run can match.
        m = (at and _EMAIL_HERE.match(text, at)) or _EMAIL.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str | None) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) of one text: by kind in the order listed, then by start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
        runs = [(*m.span(), _digits(m[0])) for m in _DIGITS.finditer(text) if m.end() - m.start() >= 13]
        found += [("card", a, b) for a, b, d in runs if 16 <= len(d) <= 19 and luhn(d)]
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text) if mod_97(m[0].replace(" ", ""))]
        found += [("short_card", a, b) for a, b, d in runs if 13 <= len(d) <= 15 and luhn(d)]
        found += [("national_id", *m.span()) for m in _NATIONAL.finditer(text)]
    out = []
    for kind, a, b in found:
        near = text[max(0, a - NEAR[0]) : a] + " " + text[b : b + NEAR[1]]
        score = min(1.0, PRIORS[kind][0] + CONTEXT_BONUS * bool(_CONTEXT[kind].search(near)))
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((kind, a, b, kind in BASE_KINDS, score))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base, score)."""

    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            worth = pc.fill_null(pc.or_(pc.match_substring(texts, "@"), pc.match_substring_regex(texts, "[0-9]")), False).to_numpy(zero_copy_only=False)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for i in worth.nonzero()[0]:
                spans[i] = [dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in find_spans(texts[int(i)].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, spans array<struct<kind:string,start:long,`end`:long,base:boolean,score:double>>"
    )


def redact(text: str, mask: str = "[{kind}]") -> str:
    """The text with every span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b, _, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mask.format(kind=kind)]
            at = b
    return "".join([*out, text[at:]])
