"""Token ids of the byte-level vocabulary, loaded once per Python worker.

The rank file and the tokenizer file hold one vocabulary; the tests compare both libraries over all
code points. The rank form is about four times as fast. Strings of special tokens in a text
are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder for ``path``, the ``.json`` of a vocabulary that has a ``.tiktoken`` file beside it."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(path: str, text: str) -> np.ndarray:
    return np.array(encoder(path).encode_ordinary(text), dtype="<u4")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
