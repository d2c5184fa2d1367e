"""Byte-level vocabularies of public tokenizer files; the files' paths are parameters."""

from __future__ import annotations

import json
import re

import numpy as np

#: The pattern that the byte-level pre-tokenizer splits texts by: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others, in order, for the
    characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(spec: dict) -> dict[bytes, int]:
    """Bytes and id of every ordinary token."""
    alphabet = byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def _is_ranked_byte_bpe(spec: dict) -> bool:
    """True if merging by least id gives what the file's merges give."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
        return False
    if not split.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
        return False
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:], strict=False))


def _stands_alone(token: dict) -> bool:
    """True if an added token is found just where its letters stand."""
    return not (token.get("single_word") or token.get("lstrip") or token.get("rstrip"))


def encoder(spec: dict):
    """A function from texts to arrays of ids; nothing is put around a text.

    A byte-level BPE whose ids follow its merges runs on tiktoken, which gives
    the same ids in a quarter of the time; any other file on tokenizers. Added
    tokens that a text spells out get their own ids, as the file says: the text
    is split there, the longest first, and what stands between is encoded by
    itself.
    """
    added = spec.get("added_tokens", [])
    if not _is_ranked_byte_bpe(spec) or not all(map(_stands_alone, added)):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_str(json.dumps(spec))
        return lambda texts: [np.array(e.ids, dtype=np.uint32) for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=pieces(spec), special_tokens={})
    ids = {t["content"]: t["id"] for t in added if t["content"]}
    split = re.compile("|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True))) if ids else None

    def encode(text: str) -> np.ndarray:
        if split is None or not (found := list(split.finditer(text))):
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        out, at = [], 0
        for m in found:
            out += [*fast.encode_ordinary(text[at : m.start()]), ids[m.group()]]
            at = m.end()
        return np.array(out + fast.encode_ordinary(text[at:]), dtype=np.uint32)

    return lambda texts: [encode(t) for t in texts]


def once_per_worker(sent, build):
    """``build(sent.value)``, kept with the broadcast variable for the life of a Python worker."""
    if not hasattr(sent, "_quarry_built"):
        sent._quarry_built = build(sent.value)
    return sent._quarry_built
