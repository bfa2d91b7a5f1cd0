"""Exact token ids of a byte-level BPE file, quick on prose.

``Encoder`` gives what ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives.
Texts in Latin letters are cut into words by the same rule the file names, and the ids of each word are kept; any
text beyond that (other scripts, special strings, words of 200 characters) goes to the library itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
from array import array

import numpy as np

# Fixed values of byte-level BPE: the printable bytes stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORDS_KEPT = 300_000
LONGEST_WORD = 200


def _byte_letters() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class _Words(dict):
    """Ids of words, as bytes; the first ``kept`` of them stay."""

    def __init__(self, encode, kept: int):
        super().__init__()
        self.encode, self.kept = encode, kept

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.encode(word.encode()))
        if sys.byteorder == "big":
            found.byteswap()
        ids = found.tobytes()
        if len(self) < self.kept:
            self[word] = ids
        return ids


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids as bytes.  ``count(text)``: how many."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.word = None
        letters, model = _byte_letters(), spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        made = [model["vocab"].get("".join(m), -1) for m in merges]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is None and made == sorted(made) and all(before.get(k) == v for k, v in plain.items()):
            import tiktoken

            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            # One word is one piece: no pattern has to run over it again.
            pieces = tiktoken.Encoding("file", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.word = _Words(pieces.encode_single_piece, kept).__getitem__
            self.odd = re.compile("|".join(
                [f"[^\\t-\\r\\x20-\\x7e{LETTERS[6:]}]", f"\\S{{{LONGEST_WORD}}}", f"\\s{{{LONGEST_WORD}}}", *map(re.escape, special)]
            ))
            self.cut = re.compile(
                f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+"
            ).findall

    def ids(self, text: str) -> bytes:
        if self.word is None or self.odd.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.word, self.cut(text)))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


@functools.lru_cache(maxsize=2)
def encoder(path: str, kept: int = WORDS_KEPT) -> Encoder:
    """One encoder for each worker process.  ``kept``: how many words it remembers, words of up to LONGEST_WORD letters, about 250 bytes each."""
    return Encoder(path, kept)


def version(path: str) -> str:
    """Digest of the tokenizer file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:32]
