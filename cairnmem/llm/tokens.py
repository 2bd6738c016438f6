"""Byte-pair token ids of whole texts.

The ids are those of ``tokenizers`` with the byte-level vocabulary ``byte_bpe_50k.json`` and
``add_special_tokens=False``: the text of the special token becomes its id.  The merges are run by
tiktoken from the same vocabulary as ranks, which is some eight times faster and gives the same ids
(``tests/llm/test_packing.py`` compares the two).
"""

from __future__ import annotations

import base64
import functools

import numpy as np

END_OF_TEXT = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str | None = None):
    """The encoder of a ranks file; by default that of ``byte_bpe_50k``.  Cached per worker."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)}
    )


def encode(text: str | None, ranks_path: str | None = None, special: bool = True) -> np.ndarray:
    """Ids of one text as uint32; none for a null or empty text.

    ``special=False`` takes the special token's text for ordinary text, so its id cannot occur.
    """
    if not text:
        return np.empty(0, np.uint32)
    own = encoder(ranks_path)
    ids = own.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
    return ids.astype(np.uint32, copy=False)
