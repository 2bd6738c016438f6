import hashlib
import re
from collections import defaultdict

import pytest
from oracle import connection, same_rows

from cairnmem.llm import exact_dedup
from cairnmem.llm.queries import ORACLE_SQL, QUERIES
from cairnmem.llm.staging import Stage


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {(i, hashlib.sha256(t.encode()).hexdigest()): (min((x for x in g if x is not None), default=None), len(g)) for t, g in groups.items() for i in g}


def test_against_sql(spark, sf_dir):
    same_rows(QUERIES["op1_exact_dedup"](spark, sf_dir), connection(sf_dir), ORACLE_SQL["op1_exact_dedup"])


@pytest.mark.parametrize("segment_bytes", [1 << 20, 4])
def test_odd_rows_and_many_segments(odd, segment_bytes):
    rows = exact_dedup.classes(odd, segment_bytes=segment_bytes).collect()
    expected = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in rows} == expected
    kept = defaultdict(int)
    for r in rows:
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(rows) == odd.count()


def test_drop_keeps_columns_and_one_of_each(odd):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns
    found = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(found) == len({re.sub(r"\s+", " ", t or "") for _, t in found if t is None or " " not in t}) + 1
    assert sorted(i for i, _ in found if i) == [1, 3, 5, 7, 8, 9, 10, 11, 12]


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("documents.parquet")


def test_documents_are_read_as_often_for_many_segments(documents):
    """Results do not change with segments, levels or a filter that is too small; nor do the scans."""
    one = exact_dedup.drop_copies(documents)
    many = exact_dedup.drop_copies(documents.repartition(5), segment_bytes=4, filter_bytes=8, fan_in=2)
    key = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.collect())
    assert key(one) == key(many)
    assert scans(one) == scans(exact_dedup.drop_copies(documents, segment_bytes=4)) == 2
    # The classes are made from staged digests: the documents have been read, once.
    assert scans(exact_dedup.classes(documents, segment_bytes=4)) == 0


def test_few_unique_rows_are_taken_for_repeated(spark):
    probed = exact_dedup._probed(spark.range(20000).selectExpr("id doc_id", "cast(id as string) text"), "doc_id", "text", Stage(spark, "test"), 1 << 20, None)
    assert probed.where("maybe").count() < 400


def test_empty(empty):
    assert exact_dedup.classes(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
