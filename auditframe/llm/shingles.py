"""Words and word shingles as 64-bit numbers, a document at a time, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd multipliers that set the places of a shingle apart.
MIX = np.random.default_rng(20240501).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Hashes of words seen; emptied when it reaches this many, to bound memory.
KEPT = 300_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose low and high bits both depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def lower_words(text: str) -> list[str]:
    """Words with A-Z in lower case; no other letters change."""
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """One number for each run of ``k`` codes."""
    n = len(codes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += stir(codes[i : i + n] + MIX[i]) * MIX[i + 32]
    return stir(out)


def shingle_set(text: str | None, seen: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct shingles of ``k`` words; of fewer words, the whole sequence as one; of none, nothing."""
    found = lower_words(text) if text else []
    if not found:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
    if len(codes) < k:
        return windows(codes, len(codes)) + np.uint64(len(codes))
    return np.unique(windows(codes, k))
