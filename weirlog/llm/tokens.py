"""Token ids of texts by a public byte-level BPE vocabulary, fast enough for whole corpora.

The vocabulary file comes as ranks or as a tokenizer file; both give the same ids. With ranks the
encoder runs several times faster, so a rank file beside the tokenizer file is used if there is one.

What the strings of added tokens (such as <|endoftext|>) inside a text are is up to the caller: ordinary
text, or, with `added`, the added token's single id, as the tokenizer file has it. A text that holds such a string
then goes to the tokenizer itself, whole and with its own settings; the ranks encode only texts without any.
"""

from __future__ import annotations

import base64
import json
import os
from functools import cache

import numpy as np


@cache
def encoder(path: str):
    """text -> list of ids. One per worker process; path names a .json (tokenizers) or .tiktoken file."""
    import public_tokenizers

    ranks = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks if path.endswith(".json") else path):
        import tiktoken

        with open(ranks if path.endswith(".json") else path, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


@cache
def whole_encoder(path: str):
    """text -> list of ids as the tokenizer file gives them, its added tokens included. path names a .json file."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        added = [x["content"] for x in json.load(file)["added_tokens"]]
    own, plain = Tokenizer.from_file(path), encoder(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids if any(x in text for x in added) else plain(text)


def token_ids(text: str | None, path: str, added: bool = False) -> np.ndarray:
    """The ids of a text as unsigned 32-bit integers; null is empty. added: strings of added tokens are these tokens."""
    return np.array((whole_encoder if added else encoder)(path)(text), dtype="<u4") if text else np.empty(0, "<u4")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
