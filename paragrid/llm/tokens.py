"""Token ids of whole texts by a public BPE vocabulary file of the word-end kind."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Entries kept of each kind in a worker's memory; beyond that its memory starts anew.
CACHE_ENTRIES = 300_000
#: Characters on which the file's Unicode tables and ours agree (tested one by one).
AGREED = r"[\x00-\u0557\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf\u3040-\u3096\u30a0-\u30ff\u4e00-\u9fef\uac00-\ud7a3]*"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Word to its ids as little-endian unsigned 32-bit integers, filled as words are met."""

    def __init__(self, model):
        super().__init__()
        letters = _byte_letters()
        self.model, self.table = model, [letters[b] for b in range(256)]

    def __missing__(self, word: str) -> bytes:
        table = self.table
        ids = [t.id for t in self.model.tokenize("".join([table[b] for b in word.encode()]))]
        self[word] = found = np.array(ids, "<u4").tobytes()
        return found


class _Chunks(dict):
    """What stands between ASCII white space, as UTF-8 bytes, to its ids."""

    def __init__(self, whole: Tokenizer, pattern: str):
        super().__init__()
        self.whole, self.words = whole, _Words(whole.model)
        self.agreed, self.split = regex.compile(AGREED).fullmatch, regex.compile(pattern).findall

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not self.agreed(text):
            found = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the file's lower case knows no final sigma
            found = b"".join(map(self.words.__getitem__, self.split(text.lower())))
        self[chunk] = found
        return found


class WordTokenizer:
    """Ids as the tokenizer file's own encode() gives them, without special tokens.

    The file's steps are NFC, white space to blanks, lower case, splitting by its pattern, and BPE of each word. None
    of them reaches over ASCII white space, and chunks repeat, so that they run once for each chunk met. A text
    holding one of the special tokens' strings goes through encode() itself, as does a chunk with characters that
    Unicode versions class differently."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.chunks = _Chunks(self.whole, self.pattern)

    def ids(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text, four little-endian bytes each."""
        if b"<|" in text and any(s in text for s in self.special):
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        if len(self.chunks.words) > CACHE_ENTRIES:
            self.chunks.words.clear()
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a worker."""
    return WordTokenizer(path)
