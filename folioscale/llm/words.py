"""Words, their hashes and windows over them, inside Python tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_NOT_SPACE = re.compile(r"[^\x20\x09-\x0d]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = (1 << 64) - 1
_CACHE_LIMIT = 400_000


def words_of(text: str | None) -> list[str]:
    return _NOT_SPACE.findall(text) if text else []


def lower_ascii(text: str | None) -> str:
    # Of bytes, lower() changes A-Z only.
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else ""


class WordHashes(dict):
    """64-bit hash per word, remembered; the memory is emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def array(self, words: list[str]) -> np.ndarray:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of so many consecutive words; none for shorter texts."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    # A window's sum from those of its halves: doubled along the bits of the width.
    out, done, power = np.zeros(len(hashes), np.uint64), 0, 1
    for bit in f"{width:b}":
        if done:
            out, done = out[: len(out) - done] * np.uint64(power) + out[done:], done * 2
            power = power * power & _WORD
        if bit == "1":
            out, done = (out[: len(hashes) - done] * _ODD + hashes[done:], done + 1) if done else (hashes, 1)
            power = power * int(_ODD) & _WORD
    return mixed(out)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each full run of ``width`` values, by doubling."""
    done, span = values, 1
    while span * 2 <= width:
        done = pick(done[:-span], done[span:])
        span *= 2
    rest = width - span
    return pick(done[: len(done) - rest], done[rest:]) if rest else done
