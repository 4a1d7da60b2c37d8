"""Byte-level BPE vocabulary files, as Python workers load them."""

from __future__ import annotations

import base64
import functools
import json


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for letters from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a .tiktoken file or from a tokenizers .json file (special tokens left out)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def added(path: str) -> dict[str, int]:
    """Added tokens of a tokenizers .json file to their ids."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=added(path))
