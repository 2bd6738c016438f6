import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairnmem.llm import packing, tokens
from cairnmem.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, t):
    return np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


ODD_TEXTS = ["", " ", "a  b", "\n\n x\t", "don't stop I'LL", "naïve café  x", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "日本語 テキスト 123", "a" * 500, "\x85\x1c ok", "🙂🙂 !!", "1234567 8.9"]


@pytest.mark.parametrize("t", ODD_TEXTS)
def test_ids_are_those_of_tokenizers(tokenizer, t):
    assert tokens.encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_round_trip(spark, sf_dir, texts, tokenizer):
    by_doc = {}
    rows = QUERIES["op8_packing"](spark, sf_dir).collect()
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        ids, at = ids_of(tokenizer, t), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_ids_and_buckets(odd, tokenizer):
    rows = packing.pack(odd, max_tokens=16).collect()
    assert all(len(r["ids"]) == r["length"] == 2 ** r["bucket"] for r in rows)
    own = sorted((r for r in rows if r["doc_id"] == 11), key=lambda r: r["start"])
    text = [r["text"] for r in odd.collect() if r["doc_id"] == 11][0]
    assert [x for r in own for x in r["ids"]] == ids_of(tokenizer, text).tolist()
    assert sum(r["doc_id"] == 10 for r in rows) == 2 * sum(1 for _ in packing.piece_lengths(len(ids_of(tokenizer, "one")), 16))


def test_empty_and_bad_sizes(empty, odd):
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, max_tokens=1000)


def test_piece_lengths():
    for n in range(1, 300):
        lengths = packing.piece_lengths(n, 64)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and max(lengths) <= 64


def test_batches_draw_from_one_bucket(documents):
    packed = packing.pack(documents, 64, with_ids=False)
    rows = packing.batches(packed, 128).collect()
    assert sorted(r["sequence_id"] for r in rows) == sorted(r["sequence_id"] for r in packed.collect())
    held = {}
    for r in rows:
        held.setdefault(r["batch_id"], []).append(r["length"])
    assert all(len(set(b)) == 1 and sum(b) <= 128 for b in held.values())
    # All but the last batch of each task and bucket are full.
    assert sum(sum(b) < 128 for b in held.values()) <= len({k.rsplit("-", 1)[0] for k in held})
