import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairnmem.llm import chunks, substring_dedup, words
from cairnmem.llm.staging import Stage


def brute(rows, n):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                keep[i : i + n] = [False] * n
        kept = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((len(w), keep.count(False), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def longest(rows, n):
    """The last of n, 2n, 4n, ... at which each text has a repeated window."""
    words, out = [(t or "").split() for _, t in rows], [0] * len(rows)
    while True:
        seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
        hit = [any(seen[tuple(w[i : i + n])] > 1 for i in range(len(w) - n + 1)) for w in words]
        if not any(hit):
            return out
        out, n = [n if h else o for h, o in zip(hit, out, strict=True)], 2 * n


@pytest.mark.parametrize("n", [35, 8])
def test_against_brute_force(documents, texts, n):
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(documents, n).collect()}
    for (i, _), expected, level in zip(texts, brute(texts, n), longest(texts, n), strict=True):
        r = found[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) == expected
        assert r["longest"] == level


@pytest.mark.parametrize("n", [1, 16, 255, 256, 300, 5000])
def test_keys_of_one_bucket_that_differ_in_any_bit_are_not_shared(spark, n):
    keys = np.array([0x0123456789ABCDEF ^ (1 << bit) for bit in range(64)] + [0x0123456789ABCDEF], np.uint64)
    how = chunks.Plan(n, n, 1, chunks.whole(n))
    sent = [b for i, k in enumerate(keys) for b in substring_dedup._sent(i, keys[i : i + 1], None, how)]
    df = spark.createDataFrame(pa.Table.from_batches(sent).to_pandas())
    found = chunks.ask(df, how, chunks.shared(), Stage(spark, "test")).collect()
    assert len(found) == 65 and not any(chunks._unnote(r["reply0"], 1, "bool")[0] for r in found)


def test_keys_of_two_checks_are_not_shared():
    keys, checks = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 1, 1, 1], "<u4")
    group, first = words.ranked(keys, checks)
    assert group.tolist() == [0, 1, 2, 0, 2] and checks[first].tolist() == [1, 2, 1] and keys[first].tolist() == [5, 5, 7]


def test_two_levels_of_exchange_give_the_same(documents, texts):
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(documents.repartition(7), 35, fan_in=2).collect()}
    for (i, _), expected in zip(texts, brute(texts, 35), strict=True):
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"], found[i]["text"]) == expected


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(odd, 35).collect())
    assert found == sorted(x[:3] for x in brute(rows, 35))


def test_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
