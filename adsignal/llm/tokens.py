"""Ids of the byte-level tokenizer, for batches of texts inside a task.

The vocabulary is read from the installed public files; both libraries give the same ids for it.  The faster one takes
the texts of Latin letters and common signs; a text that holds a special token's string, a letter outside those blocks
(where two libraries' Unicode tables may differ), or a very long run without spaces goes to the tokenizers library.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_OTHER = re.compile("<\\||[^\x00-ſ‐-‧‰-⁞€]|\\S{1500}")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary as ranks, where such a file stands beside it."""
    ranks_path = f"{path.removesuffix('.json')}.tiktoken"
    if not os.path.exists(ranks_path):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str, path: str) -> np.ndarray:
    """As Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids."""
    fast = _fast(path)
    if fast is None or _OTHER.search(text):
        return np.array(_exact(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.frombuffer(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4") if hasattr(fast, "encode_to_numpy") else np.array(fast.encode_ordinary(text), dtype="<u4")
