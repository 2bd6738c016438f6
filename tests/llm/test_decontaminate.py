from collections import Counter

import numpy as np
import pyarrow as pa

from cairnmem.llm import decontaminate
from cairnmem.llm.queries import QUERIES


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, items, threshold=0.8):
    out = {}
    for i, t in docs:
        w = (t or "").lower().split()
        own = set(bag(w))
        for j, q in items:
            x = (q or "").lower().split()
            s = bag(x)
            if not x or len(x) >= 5 and len(own & set(s)) < threshold * len(s) * 0.5:
                continue
            best = (0.0, 0)
            for a in range(max(1, len(w) - len(x) + 1)):
                b = bag(w[a : a + len(x)]) if len(x) >= 5 else Counter([tuple(w[a : a + len(x)])])
                score = sum((b & s).values()) / max(1, sum((b | s).values()))
                best = max(best, (score, -a))
            if best[0] >= threshold:
                out[i, j] = (best[0], -best[1])
    return out


def test_against_brute_force(spark, sf_dir, texts):
    rows = QUERIES["op7_decontamination"](spark, sf_dir).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute(texts, items)
    assert expected and {(r["doc_id"], r["item_id"]) for r in rows} == set(expected)
    for r in rows:
        score, at = expected[r["doc_id"], r["item_id"]]
        assert abs(r["similarity"] - score) < 1e-9 and r["first_word"] == at


def test_edits_blocks_and_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    item = " ".join(f"q{i}" for i in range(40))
    words = item.split()
    one = " ".join(words[:39] + ["new"])
    many = " ".join(w if i % 4 else "zz" for i, w in enumerate(words))
    rows = [(100, "before " + item.upper() + " after"), (101, one), (102, many), (103, " ".join(words[:36])), (104, "tiny match here")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    items = [(1, item), (2, None), (3, ""), (4, "tiny match"), (None, "unseen words only"), (5, item)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").coalesce(1)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    assert found == set(brute(rows, items)) == {(100, 1), (100, 5), (101, 1), (101, 5), (103, 1), (103, 5), (104, 4)}
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(50)]
    index = decontaminate.Index(items)
    prints = index.sizes[20][2]
    flips = np.zeros((300, 128), bool)
    for f in flips:
        f[rng.choice(128, rng.integers(0, 60), replace=False)] = True
    asked = prints[rng.integers(0, 50, 300)] ^ np.packbits(flips, axis=1)
    distance = np.unpackbits(asked[:, None, :] ^ prints[None, :, :], axis=2).sum(axis=2)
    assert set(index._candidates(20, asked)) == {(a, b) for a, b in zip(*np.nonzero(distance <= index.radius), strict=True)}


def test_a_run_of_one_filler_word_stays_within_reach():
    items = [(i, " ".join(f"f{i}w{k}" for k in range(204))) for i in range(20)]
    rows = [(i, " ".join(t.split()[:182] + ["uh"] * 22)) for i, t in items]
    index = decontaminate.Index(items)
    found = {(r, i) for r, i, *_ in index.matches(pa.array([t for _, t in rows]))}
    assert found == set(brute(rows, items)) == {(i, i) for i in range(20)}


def test_a_verbatim_copy_in_letters_with_odd_lower_case():
    items = [(1, " ".join(f"İSTANBUL{k}İ ΟΔΟΣ" for k in range(12))), (2, "ΛΟΓΟΣ ΝΟΜΟΣ ΤΟΠΟΣ ΧΡΟΝΟΣ ΒΙΟΣ ΠΟΝΟΣ ΔΗΜΟΣ ΚΟΣΜΟΣ")]
    index = decontaminate.Index(items)
    found = index.matches(pa.array([f"before {t} after" for _, t in items]))
    assert {(r, i, first, s) for r, i, first, _, s in found} == {(0, 1, 1, 1.0), (1, 2, 1, 1.0)}


def test_a_long_item_in_a_long_text():
    rng = np.random.default_rng(1)
    item = [f"v{k}" for k in rng.integers(0, 3000, 10_000)]
    copy = [w if k % 60 else "edit" for k, w in enumerate(item)]
    text = [f"z{k}" for k in range(300)] + copy + [f"z{k}" for k in range(200)]
    items = [(1, " ".join(item)), (2, " ".join(item[:500]))]
    found = decontaminate.Index(items).matches(pa.array([" ".join(text)]))
    expected = brute([(0, " ".join(text))], items)
    assert {(r, i): (round(s, 9), first) for r, i, first, _, s in found} == {k: (round(s, 9), at) for k, (s, at) in expected.items()} and len(found) == 2


def test_sliding_is_the_same_as_starting_anew():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 400)]
    slid = decontaminate.Windows(h, 37)
    bags = [Counter(h[a : a + 37].tolist()) for a in range(364)]
    assert (slid.prints() == np.concatenate([decontaminate.Windows(h[a : a + 37], 37).prints() for a in range(364)])).all()
    own = Counter(rng.choice(h, 30).tolist())
    expected = [sum((b & own).values()) / sum((b | own).values()) for b in bags]
    kinds = sorted(own)
    got = slid.similarities(np.array(kinds, np.uint64), np.array([own[x] for x in kinds]))
    assert np.allclose(got, expected)


def test_recall_and_pruning_of_the_multi_index():
    """Windows of similarities just above the threshold are candidates; unlike ones hardly ever are."""
    rng = np.random.default_rng(3)
    found = tried = unlike = 0
    for m, changed in ((9, 1), (19, 2), (46, 5), (100, 11), (400, 44)):  # similarities of 0.80 to 0.81
        items = rng.integers(0, 2**63, (300, m), dtype=np.uint64)
        edited = items.copy()
        edited[:, :changed] = rng.integers(0, 2**63, (300, changed), dtype=np.uint64)
        index = decontaminate.Index([])
        prints, asked = (np.concatenate([decontaminate.Windows(x, m).prints() for x in y]) for y in (items, edited))
        index.sizes[m] = (list(range(300)), None, prints)
        keys = index._asked(prints)
        order = np.argsort(keys, axis=None)
        index._index[m] = (keys.ravel()[order], (order // keys.shape[1]).astype(np.int32))
        pairs = set(index._candidates(m, asked))
        found, tried, unlike = found + sum((i, i) in pairs for i in range(300)), tried + 300, unlike + sum(a != b for a, b in pairs)
    assert found / tried > 0.999 and unlike / (tried * 299) < 1e-3


def test_empty(spark, sf_dir, empty, odd):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(odd, bench.where("false")).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.where("false")).count() == odd.count()
