"""Token ids as the ``tokenizers`` library gives them for a vocabulary file.

For a plain byte-level BPE file the merges are also handed to ``tiktoken``, which runs the same
merges about five times faster. It is used only where both must agree: the file has no
normaliser, every merge's rank is the id of what it makes, and the text has Latin-1 characters
only and no special string. Every other text goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np


def version_digest(path: str) -> str:
    """Digest of the vocabulary file: counts of another version never match."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


@lru_cache(maxsize=4)
def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def _fast(path: str):
    """The same merges as a ``tiktoken`` encoding, and the special strings; None if unlike."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not spec.get("normalizer")
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
        and not model.get("ignore_merges")
    )
    if not plain:
        return None
    special = [t["content"] for t in spec.get("added_tokens", [])]
    byte = _byte_of_char()
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    singles = [ranks.get(bytes([b]), -1) for b in range(256)]
    if made != sorted(set(made)) or len(made) + 256 != len(ranks) or min(singles) < 0 or max(singles) > made[0]:
        return None
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, special


def vocabulary(path: str) -> dict[str, int]:
    """Token strings, as the file writes them, and their ids."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids (uint32) of every whole text, without begin, end or padding ids."""
    out: list = [None] * len(texts)
    fast = _fast(path)
    rest = []
    for i, text in enumerate(texts):
        if fast and not any(s in text for s in fast[1]):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                out[i] = fast[0].encode_to_numpy(text, disallowed_special=())
                continue
        rest.append(i)
    if rest:
        found = _library(path).encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, encoded in zip(rest, found):
            out[i] = np.array(encoded.ids, dtype=np.uint32)
    return out


def blocks(texts: list[str], chars: int = 2_000_000):
    """Start and end of runs of texts of bounded size, so that few ids are held at once."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
