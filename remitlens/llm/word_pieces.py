"""Ids of a word-end BPE tokenizer, a text at a time, with every distinct word encoded once per worker."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Python's split() takes these for white space, the tokenizer doesn't
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: bytes of words and ids kept in each of the two caches by default, and what an entry takes besides
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 160


class WordEncoder:
    """The same ids as the tokenizers library gives, special tokens' strings being ordinary text.

    No piece reaches over white space and no merge over a word, so a text is cut at white space, each run is cut into words
    by the tokenizer's own pattern, and each new word goes through the library. Caches are emptied when they are full.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.cache_bytes = cache_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed: the tokenizer's own words
        self.model = self.tokenizer.model
        # byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
        self.letters = {b: 256 + k for k, b in enumerate(odd)}
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = {"runs": 0, "words": 0}

    def plain(self, text: str) -> str:
        """The tokenizer's normal form, but for white space."""
        if text.isascii():
            return text.lower()
        if "Σ" in text or not unicodedata.is_normalized("NFC", text):  # a capital sigma lowers by its place in Python
            return self.tokenizer.normalizer.normalize_str(text)
        return text.lower()

    def runs_of(self, text: str) -> list[str]:
        text = self.plain(text)
        return text.split() if SEPARATORS.search(text) is None else regex.findall(r"\S+", text)

    def symbols(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def _keep(self, name: str, text: str, ids: bytes) -> None:
        """Put an entry into a cache, which starts anew when it is full. Words longer than a cache is good for aren't kept."""
        if len(text) > 64:
            return
        cache: dict[str, bytes] = getattr(self, name)
        size = ENTRY_BYTES + len(text) + len(ids)
        if self.held[name] + size > self.cache_bytes:
            cache.clear()
            self.held[name] = 0
        cache[text] = ids
        self.held[name] += size

    def _run(self, run: str) -> bytes:
        parts = []
        for word in self.pattern.findall(run):
            ids = self.words.get(word)
            if ids is None:
                ids = np.array([t.id for t in self.model.tokenize(self.symbols(word))], np.uint16).tobytes()
                self._keep("words", word, ids)
            parts.append(ids)
        out = b"".join(parts)
        self._keep("runs", run, out)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text as 16-bit numbers."""
        known, new = self.runs.get, self._run
        return np.frombuffer(b"".join([known(r) or new(r) for r in self.runs_of(text)]), np.uint16)


@lru_cache(maxsize=4)
def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> WordEncoder:
    """One encoder for each file, size of caches and worker."""
    found = WordEncoder(path, cache_bytes)
    if found.tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError(f"{path}: ids over 16 bits")
    return found
