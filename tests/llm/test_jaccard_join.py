import random
from collections import Counter, defaultdict

import pytest

from cairnmem.llm import jaccard_join
from cairnmem.llm.components import components
from cairnmem.llm.staging import Stage


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """Size and smallest doc_id of the component of each row."""
    sets = [shingles(t, n) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x] if j > k).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(j)] = find(k)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [(len(s), min((i for i in least[find(k)] if i is not None), default=None)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(documents, texts, n, percent):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(documents, n, percent).collect()}
    assert [found[i] for i, _ in texts] == brute(texts, n, percent)


@pytest.mark.parametrize("per_entry", [16, 0])
def test_large_group_of_near_copies(spark, monkeypatch, per_entry):
    """Near copies of one text and of near copies, by leaders alone or with the rest looked at directly."""
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ENTRY", per_entry)
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(9999)}" for _ in range(80)) + " " + " ".join(base[:20])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(df, 4, 85).collect()}
    assert [found[i] for i, _ in rows] == brute(rows, 4, 85)


def group(size, least, most):
    """Copies of a text with so many words replaced by new ones, and texts that share a passage with it."""
    rng = random.Random(size)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(size):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(least, most)):
            words[at] = f"e{rng.randrange(3000)}"
        rows.append((i, " ".join(words[: rng.randint(110, 120)])))
    return rows + [(size + i, " ".join(f"u{i % 7} {rng.randrange(50)}" for _ in range(60)) + " " + " ".join(base[:30])) for i in range(size // 4)]


@pytest.mark.parametrize(("least", "most"), [(0, 5), (1, 2), (2, 9)])
def test_hot_lists_without_rounds(spark, monkeypatch, least, most):
    """All links are found where every list is hot and no round has connected anything, whether or not a text is amid the others."""
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 1)
    monkeypatch.setattr(jaccard_join._Join, "_star", lambda self, seed, leaders: False)
    rows = group(150, least, most)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(df, 4, 85).collect()}
    assert [found[i] for i, _ in rows] == brute(rows, 4, 85)


def test_pairs_grow_with_the_group(spark, monkeypatch):
    """Twice the near copies of a text have about twice the pairs tested, those that do not link included."""
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 32)
    connect, counts = jaccard_join._Join._connect, []

    def counted(self, pairs):
        pairs = self.stage.write(pairs, "counted")
        counts[-1] += pairs.count()
        return connect(self, pairs)

    monkeypatch.setattr(jaccard_join._Join, "_connect", counted)
    for size in (200, 800):
        counts.append(0)
        rows = group(size, 0, 5)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(df, 4, 85).collect()}
        assert [found[i] for i, _ in rows] == brute(rows, 4, 85)
    assert counts[1] <= 8 * counts[0], counts


def test_short_lists_leave_the_rounds(spark, monkeypatch):
    """Unlike texts of passages that two have each are tested at once; neither their lists nor their n-grams go through the rounds of a large group."""
    star, seen = jaccard_join._Join._star, []

    def counted(self, seed, leaders):
        rows = self.index.select("row").distinct()
        seen.append((self.index.count(), self.segments.join(rows, "row", "left_anti").select("row").distinct().count()))
        return star(self, seed, leaders)

    monkeypatch.setattr(jaccard_join._Join, "_star", counted)
    passages = [" ".join(f"p{i} {k}" for k in range(20)) for i in range(600)]
    rows = group(300, 0, 5) + [(10000 + i, f"{passages[i - 1]} {passages[i]}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(df, 4, 85).collect()}
    assert [found[i] for i, _ in rows] == brute(rows, 4, 85)
    assert len(seen) > 2 and 2 * seen[2][0] < seen[0][0] and seen[2][1] < 100, seen


@pytest.mark.parametrize("hot_list", [256, 32])
def test_only_frequent_ngrams_are_dealt_in_parts(spark, monkeypatch, hot_list):
    """What there is of a list is copied to parts where the list may be hot, and every hot list may be."""
    monkeypatch.setattr(jaccard_join, "HOT_LIST", hot_list)
    every, start, counts = jaccard_join._every, jaccard_join._Join.__init__, []

    def counted(lists, hot=None):
        out = every(lists, hot)
        counts.append((lists.count(), out.count()))
        return out

    def started(self, index, segments, percent, stage):
        start(self, index, segments, percent, stage)
        counts.extend((r["count"], 0) for r in index.where("not hot").groupBy("token").count().where(f"count > {hot_list}").collect())

    monkeypatch.setattr(jaccard_join, "_every", counted)
    monkeypatch.setattr(jaccard_join._Join, "__init__", started) if hot_list < 256 else None
    rows = group(100, 0, 5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_copies(df, 4, 85).collect()}
    assert [found[i] for i, _ in rows] == brute(rows, 4, 85)
    assert counts and all(out for _, out in counts) and (hot_list < 256 or all(out == n for n, out in counts)), counts


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    out = jaccard_join.near_copies(odd, 4, 85).collect()
    none_last = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=none_last)
    assert found == sorted(((i, *b) for (i, _), b in zip(rows, brute(rows, 4, 85), strict=True)), key=none_last)


def test_drop_keeps_columns_and_one_of_each(documents, texts):
    out = jaccard_join.drop_near_copies(documents, 5, 80)
    assert out.columns == documents.columns
    assert {r["doc_id"] for r in out.collect()} == {i for (i, _), (_, c) in zip(texts, brute(texts, 5, 80), strict=True) if i == c}


def test_drop_with_clashing_columns(odd):
    out = jaccard_join.drop_near_copies(odd, 5, 80)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} >= {1, 3, 4, 5, 7, 9, 10, 11, 12}


def test_empty(empty):
    assert jaccard_join.near_copies(empty).count() == 0 and jaccard_join.drop_near_copies(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(70)) if a != b] + [(200 + i, 201 + i) for i in range(30)] + [(3, 3)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = components(spark.createDataFrame(links, "a bigint, b bigint"), Stage(spark, "test")).collect()
    assert {r["id"]: r["root"] for r in rows} == {x: find(x) for x in parent if find(x) != x} and len(rows) == len({r["id"] for r in rows})
