"""Words of a batch of texts as arrays of 64-bit hashes, the documents one after another."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
REMEMBERED = 100_000  # words whose hash a worker remembers, some 200 bytes each
PART = 1 << 20  # characters of a text that are cut into words at once


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode())
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


_hashes = _Hashes()
forget = _hashes.clear


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about PART characters, cut at blanks and line feeds: no word, and no letter's case, spans them."""
    at = 0
    while len(text) - at > PART:
        cut = max(text.rfind(" ", at, at + PART), text.rfind("\n", at, at + PART))
        if cut < 0:
            later = [x for x in (text.find(" ", at + PART), text.find("\n", at + PART)) if x >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each lower-case word (a run of letters, digits and underscores)."""
    out = []
    for part in _parts(text or ""):
        found = WORD.findall(part.lower())
        out.append(np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def joined(parts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All words in one array, `gap` fillers (no word's hash, but for chance) after each document; and where each begins."""
    sizes = np.array([len(p) + gap for p in parts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(begins[-1]), np.uint64)
    filler = mix(np.arange(gap, dtype=np.uint64) + np.uint64(0x5F1E))
    for p, b in zip(parts, begins.tolist()):
        out[b : b + len(p)] = p
        out[b + len(p) : b + len(p) + gap] = filler
    return out, begins


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(k: int) -> np.uint64:
    """The k-th of a row of odd multipliers."""
    return mix(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)
