import re

import numpy as np
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as near
from test_packing import ids_of

import corpus_pipeline
from cairnmem.llm import quality
from cairnmem.llm.staging import Stage


def test_stages_against_brute_force(spark, sf_dir, documents):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    stage, docs = Stage(spark, "test"), documents
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, function in corpus_pipeline.STAGES:
        before = rows(docs)
        out = stage.write(function(spark, docs, sf_dir), "out")
        if name == "packing":
            own = {}
            for r in out.collect():
                own.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
            for i, t in before:
                assert np.concatenate([own[i][k] for k in sorted(own[i])]).tolist() == ids_of(tokenizer, t).tolist()
            continue
        assert out.columns == documents.columns
        left = {i for i, _ in rows(out)}
        if name == "quality classifier":
            scored = quality.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
            assert left == {r["doc_id"] for r in scored if r["predicted"]}
        elif name == "exact dedup":
            first = {}
            for i, t in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert left == set(first.values())
        elif name == "n-gram Jaccard join":
            assert left == {i for (i, _), (_, c) in zip(before, near(before, 5, 80), strict=True) if i == c}
        else:
            assert left == {i for i, _ in before} - {i for i, _ in leaks(before, items)}
        docs = out


def test_run_gives_the_last_stage(spark, sf_dir):
    assert "ids_crc32" in corpus_pipeline.run(spark, sf_dir).columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
