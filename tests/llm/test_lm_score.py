import math
import zlib
from collections import Counter

import numpy as np
import pytest

from oracle import connection, same_rows

from cairnmem.llm import lm_score

#: What the contract fixes, in SQL; crc32_of is a function of the test, as DuckDB has none.
BASE_SQL = r"""
    WITH d AS (SELECT doc_id, crc32_of(doc_id) % 7 = 2 AS held_out,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
               FROM documents),
    t AS (SELECT doc_id, held_out, unnest(list_append(words, ' ')) AS word FROM d),
    c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
    n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens,
           sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
    FROM t LEFT JOIN c USING (word), n GROUP BY doc_id, held_out
"""


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def base_model(rows):
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    return c, sum(c.values()), len(c)


def check(rows, found):
    c, n, v = base_model(rows)
    for r, (i, t) in zip(found, rows, strict=True):
        assert r["n_tokens"] == len(tokens(t)) and r["n_known"] == sum(c[w] > 0 for w in tokens(t)) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), rel=1e-9)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)


def test_against_brute_force(documents, texts):
    found = {r["doc_id"]: r for r in lm_score.scores(documents).collect()}
    check(texts, [found[i] for i, _ in texts])
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def interpolated(rows):
    """Scores by dictionaries: expectation-maximisation over every deleted token, without cells or hashes."""
    crc = {i: zlib.crc32(str(i).encode()) for i, _ in rows}
    train = [(i, tokens(t)) for i, t in rows if crc[i] % 7 != 2]
    part = [t for i, t in train if crc[i] // 7 % 8 == 0]

    def count(docs):
        one, two = Counter(), Counter()
        for d in docs:
            one.update(d)
            two.update(zip(["start", *d], d, strict=False))
        return one | Counter({"start": len(docs)}), two, sum(len(d) for d in docs), len({w for d in docs for w in d})

    def estimates(d, one, two, n, v):
        for before, w in zip(["start", *d], d, strict=False):
            # Words are bytes, so "start" is none of them.
            seen = one[before]
            yield min(int(math.log2(seen + 1)), 39), 1 / (v + 1), one[w] / n, two[before, w] / seen if seen else 0.0

    model = count([t for i, t in train if crc[i] // 7 % 8])
    seen = Counter(e for d in part for e in estimates(d, *model))

    def em(items, prior):
        w = [x / sum(prior) for x in prior]
        for _ in range(60):
            new = list(prior)
            for (_, *p), times in items:
                total = sum(a * b for a, b in zip(w, p, strict=True))
                for k in range(3):
                    new[k] += times * w[k] * p[k] / total
            w = [x / sum(new) for x in new]
        return w

    pooled = em(seen.items(), [1e-2] * 3)
    weights = {b: em([x for x in seen.items() if x[0][0] == b], [x + 1e-6 for x in pooled]) for b in {e[0] for e in seen}}
    model = count([t for _, t in train])
    return {i: sum(math.log10(sum(a * b for a, b in zip(weights.get(b, pooled), p, strict=True))) for b, *p in estimates(tokens(t), *model)) for i, t in rows}


def test_scores_against_brute_force(documents, texts):
    expected = interpolated(texts)
    errors = [abs(r["score"] / expected[r["doc_id"]] - 1) for r in lm_score.scores(documents).collect()]
    assert max(errors) < 2e-3 and sum(errors) / len(errors) < 2e-4


def test_base_columns_against_sql(spark, sf_dir):
    con = connection(sf_dir)
    con.create_function("crc32_of", lambda i: zlib.crc32(str(i).encode()), ["BIGINT"], "BIGINT")
    same_rows(lm_score.scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("score"), con, BASE_SQL)


def test_two_levels_of_exchange_give_the_same(documents):
    one, two = ({r["doc_id"]: r for r in lm_score.scores(documents.repartition(5), fan_in=k).collect()} for k in (None, 2))
    for i, r in one.items():
        assert r["score"] == pytest.approx(two[i]["score"]) and (r["n_known"], r["train_tokens"]) == (two[i]["n_known"], two[i]["train_tokens"])


def test_mixture_is_a_distribution():
    """By hand: what the estimates of all words and of one unknown sum to is 1, for any weights of the model."""
    w = lm_score.learn(np.array([3, 3, 1]), np.array([2.0, 0.0, 0.0]), np.array([2**0.375, 2**0.375, 0.0]), np.array([50.0, 20.0, 5.0]))
    assert w.shape == (lm_score.CONTEXT_BUCKETS, 3) and w.sum(axis=1) == pytest.approx(np.ones(len(w))) and (w > 0).all()
    counts, pairs, v = np.array([5, 3, 2]), np.array([2, 0, 2]), 3
    for row in w:
        known = row[0] / (v + 1) + row[1] * counts / counts.sum() + row[2] * pairs / pairs.sum()
        assert known.sum() + row[0] / (v + 1) == pytest.approx(1)


def test_em_prefers_what_predicts():
    good_pairs = lm_score.learn(np.array([2]), np.array([64.0]), np.array([2**-1.5]), np.array([100.0]))
    assert good_pairs[2].argmax() == 2
    unseen = lm_score.learn(np.array([0]), np.array([0.0]), np.array([0.0]), np.array([100.0]))
    assert unseen[0].argmax() == 0


def test_odd_rows(odd):
    rows = lm_score.scores(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == by_id[5]["n_tokens"] == 1 and not by_id[None]["held_out"]


def test_empty(empty):
    assert lm_score.scores(empty).count() == 0


def test_only_held_out(spark):
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.scores(spark.createDataFrame([(i, "a b")], "doc_id bigint, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)
