"""Ids of a tokenizer file whose splitting never looks across white space, chunk by chunk with a bounded memory.

``ChunkEncoder.ids(text)`` gives what ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives, as
bytes of little-endian whole numbers.  If the file turns white space into spaces, composes and lower-cases character by
character, and takes only pieces without white space, then the ids of a text are those of its chunks between white space,
each encoded by the library once and remembered.  Texts in Latin letters are cut further, into the words of the file's own
rule, whose ids come from merging bytes by rank; ``many`` cuts and looks up the words of many such texts at once with numpy, in a
table of the words seen so far, so that each is merged once.  Any other file, and texts in which a special string or one of the four
separators that Python alone calls white space occurs, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

from antecede.llm.tokens import _byte_letters as byte_letters

WORDS_KEPT, CHUNKS_KEPT = 200_000, 50_000  # at most 64 characters each, about 250 bytes with its ids
LONGEST_KEPT = 64
AT_ONCE = 1 << 23  # letters of texts that are cut at once
LONGEST_PACKED = 16  # letters of a word that is compared as two whole numbers
SLOT_BITS = 20  # of the table of such words, half of which is filled at most; 21 bytes a slot
PROBES = 8
#: By a word's length: the letters that its first and its second whole number hold.
HALVES = [np.array([(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(LONGEST_PACKED + 1)], np.uint64) for at in (0, 8)]
LETTERS = "a-zß-öø-ÿ"
#: Bytes of words in these letters.
LATIN = sorted({b for c in [*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)] for b in chr(c).encode()})
#: Small letters of Latin 1.
SMALL = "".join(map(chr, range(256))).lower().encode("latin-1")
#: The steps under which a chunk may be encoded by itself.
BY_CHARACTER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _by_chunks(spec: dict) -> bool:
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    if normal.get("type") != "Sequence" or normal.get("normalizers") != BY_CHARACTER or before.get("type") != "Sequence":
        return False
    steps = before["pretokenizers"]
    split = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
    return len(steps) == 2 and steps[0] == split and steps[1].get("type") == "ByteLevel" and not (
        steps[1].get("add_prefix_space") or steps[1].get("use_regex")
    )


def _in_order(model: dict) -> bool:
    """Whether each merge makes a later id than the one before, so that ids rank merges."""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    return bool(made) and made == sorted(made) and bool(model.get("end_of_word_suffix")) and not model.get("ignore_merges")


class _Kept(dict):
    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(self) < self.most and len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids


class _Words:
    """Ids of words in Latin letters, by merging bytes.  A word's last byte counts as another byte, as its end belongs to it."""

    def __init__(self, model: dict):
        import tiktoken

        letters, end = byte_letters(), model["end_of_word_suffix"]
        inner = bytes.maketrans(bytes(LATIN), bytes(range(len(LATIN))))
        last = bytes.maketrans(bytes(LATIN), bytes(range(len(LATIN), 2 * len(LATIN))))
        self.inner, self.last, known = inner, last, set(LATIN)
        ranks = {}
        for token, number in model["vocab"].items():
            ends = token.endswith(end) and token != end
            raw = [letters.get(c) for c in (token[: -len(end)] if ends else token)]
            if raw and known.issuperset(raw):
                ranks[self._piece(bytes(raw)) if ends else bytes(raw).translate(inner)] = number
        self.merge = tiktoken.Encoding("file", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _piece(self, raw: bytes) -> bytes:
        return raw[:-1].translate(self.inner) + raw[-1:].translate(self.last)

    def __call__(self, word: str) -> list[int]:
        return self.merge(self._piece(word.encode()))


class _Table:
    """Where the ids of words lie in ``flat``; a word is two whole numbers, the first of them never 0."""

    def __init__(self, dtype: np.dtype, bits: int = SLOT_BITS):
        self.bits, self.words = bits, 0
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at, self.count = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint8)
        self.flat = np.zeros(0, dtype)

    def find(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, and which words have none."""
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        for _ in range(PROBES - 1):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            at = slot[rest]
            rest = rest[(self.low[at] != low[rest]) | (self.high[at] != high[rest])]
        return slot, rest

    def keep(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Different words that have no slot: the table takes all of them or none; one whose slots are taken stays out."""
        if self.words + len(key) > 1 << (self.bits - 1) or len(flat) > 8 << self.bits:
            return
        self.flat = flat
        slot, rest = (key >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(key))
        for _ in range(PROBES):
            free = rest[self.low[slot[rest]] == 0]
            _, first = np.unique(slot[free], return_index=True)  # one word for each slot
            won = free[first]
            to = slot[won]
            self.low[to], self.high[to], self.at[to], self.count[to] = low[won], high[won], at[won], count[won]
            self.words += len(won)
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        #: Two bytes an id where the vocabulary allows it.
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.separator = re.compile("[\x1c-\x1f]").search
        self.chunk = _Kept(self._encode, CHUNKS_KEPT).__getitem__ if _by_chunks(spec) else None
        self.word = None
        if self.chunk is not None and _in_order(spec["model"]):
            self.merged, plain = _Words(spec["model"]), re.compile(f"[{LETTERS}]+").fullmatch
            self.word = _Kept(
                lambda w: np.array(self.merged(w), dtype=self.dtype).tobytes() if plain(w) else self._encode(w), WORDS_KEPT
            ).__getitem__
            self.table = _Table(self.dtype)
            self.odd = re.compile("[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]").search
            self.cut = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s{LETTERS}0-9]+").findall

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        if self.chunk is None or any(s in text for s in self.special):
            return self._encode(text)
        if self.word is not None and not self.odd(text):
            return b"".join(map(self.word, self.cut(text.lower())))
        return self._encode(text) if self.separator(text) else b"".join(map(self.chunk, text.split()))


    def many(self, texts: list[str]) -> list[bytes]:
        """``ids`` of each text."""
        out: list[bytes] = [b""] * len(texts)
        here: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if self.word is None or self.odd(text) or any(s in text for s in self.special):
                out[i] = self.ids(text)
                continue
            here.append(i)
            size += len(text)
            if size >= AT_ONCE:
                self._together(texts, here, out)
                here, size = [], 0
        self._together(texts, here, out)
        return out

    def _together(self, texts: list[str], here: list[int], out: list[bytes]) -> None:
        if not here:
            return
        # One byte a letter: texts in these letters are Latin 1, and so are their small letters.
        raw = "\n".join([texts[i] for i in here]).encode("latin-1").translate(SMALL)
        raw += b"\n" * (LONGEST_PACKED + 8 + -len(raw) % 8)
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_bounds(data)
        lengths = ends - starts
        low, high = packed_words(data, starts, lengths)
        key = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        long = np.flatnonzero(lengths > LONGEST_PACKED)
        low[long] = 0  # in no slot
        slot, rest = self.table.find(key, low, high)
        key[long] = long  # each by itself
        _, first, which = np.unique(key[rest], return_index=True, return_inverse=True)
        first = rest[first]
        alike = (low[rest] == low[first][which]) & (high[rest] == high[first][which]) & (lengths[rest] == lengths[first][which])
        if not alike.all():  # two words of one key
            for i in here:
                out[i] = self.ids(texts[i])
            return
        ids, sizes = self._ids_of(raw, starts[first], ends[first], KINDS[data[starts[first]]] == LETTER)
        flat, counts, offset = np.concatenate([self.table.flat, ids]), self.table.count[slot].astype(np.int64), self.table.at[slot].astype(np.int64)
        place = len(self.table.flat) + np.cumsum(sizes) - sizes
        counts[rest], offset[rest] = sizes[which], place[which]
        short = np.flatnonzero(lengths[first] <= LONGEST_PACKED)
        kept = first[short]
        self.table.keep(key[kept], low[kept], high[kept], place[short], sizes[short], flat)
        del data, ends, lengths, low, high, key, slot
        after = np.cumsum(counts)
        offset -= after - counts
        where = np.repeat(offset, counts)
        where += np.arange(len(where))
        del offset, counts
        whole = flat[where].tobytes()
        del where
        bounds = np.cumsum([len(texts[i]) + 1 for i in here])
        words = np.searchsorted(starts, bounds)
        stops = np.concatenate([[0], after])[words] * self.dtype.itemsize
        for i, a, b in zip(here, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            out[i] = whole[a:b]

    def _ids_of(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one word after the other, and how many each has.  ``plain``: which are letters only."""
        ids, sizes = [], []
        for a, b, letters in zip(starts.tolist(), ends.tolist(), plain.tolist(), strict=True):
            word = raw[a:b].decode("latin-1")
            own = self.merged(word) if letters and b - a <= LONGEST_KEPT else np.frombuffer(self.word(word), self.dtype).tolist()
            ids += own
            sizes.append(len(own))
        return np.array(ids, self.dtype), np.array(sizes, np.int64)


SPACE, LETTER, DIGIT, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
KINDS[[*range(ord("0"), ord("9") + 1)]] = DIGIT
KINDS[[*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER


def packed_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 letters of each word as two whole numbers.  ``data``: whole groups of eight, 16 bytes after the last word."""
    eight, group, shift = data.view("<u8"), starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    first, second, third = eight[group], eight[group + 1], eight[group + 2]
    one, back = np.uint64(1), np.uint64(63) - shift  # no shift by 64
    size = np.minimum(lengths, LONGEST_PACKED)
    return (first >> shift | second << one << back) & HALVES[0][size], (second >> shift | third << one << back) & HALVES[1][size]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of Latin-1 small letters begin and end: runs of letters, single digits, runs of other signs, and
    an apostrophe with an ending (s, t, m, d, re, ve, ll) if no other sign stands before it.  ``data`` ends with white space.
    """
    kind = KINDS[data]
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], SPACE
    start = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    sign = np.flatnonzero((data == ord("'")) & start)
    sign = sign[kind[sign + 1] == LETTER]
    one, two = data[sign + 1], data[sign + 2]
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(short, 1, np.where(long, 2, 0))
    sign, size = sign[size > 0], size[size > 0]
    start[sign + 1] = False
    rest = sign + 1 + size
    start[rest[kind[rest] == LETTER]] = True
    last = np.empty_like(start)
    last[:-1] = start[1:] | (kind[1:] == SPACE)
    last[-1:] = True
    return np.flatnonzero(start), np.flatnonzero(last & (kind != SPACE)) + 1


@functools.lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
