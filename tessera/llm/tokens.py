"""Token ids of a public byte-level BPE vocabulary, as the tokenizers library gives them.

tiktoken reads the same vocabulary as ranks and gives the same ids several times faster, so texts of plain Latin
characters without the special token's string go there; every other text goes to tokenizers itself.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Characters on which both libraries' splitting patterns agree beyond doubt.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u024f]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _exact(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


@lru_cache(maxsize=2)
def _fast(path: str):
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(texts: Sequence[str | None], path: str) -> Iterator[np.ndarray]:
    """The ids (uint32) of each text, without special tokens added; a null text has none."""
    tokenizer, special = _exact(path)
    fast = _fast(path)
    for text in texts:
        if not text:
            yield np.zeros(0, np.uint32)
        elif fast is not None and _PLAIN.fullmatch(text) and not any(s in text for s in special):
            yield np.asarray(fast.encode_to_numpy(text), np.uint32)
        else:
            yield np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
