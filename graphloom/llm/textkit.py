"""Words and rolling hashes of many texts at once, with numpy.

Texts are laid end to end with a space between, so no word goes across two of them. Hashes are polynomials over
random 64-bit values of bytes, modulo 2**64: prefix sums give the hash of any stretch in two look-ups. They are
mixed before use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .held import release

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x67726170))
BYTE_VALUE = _RNG.integers(0, 1 << 64, 256, dtype=U) | U(1)
BASE = int(_RNG.integers(0, 1 << 64, dtype=U)) | 1
WORD_FACTOR = _RNG.integers(0, 1 << 64, 64, dtype=U) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values, another for each salt."""
    x = (x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)).astype(U, copy=False)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, base & (1 << 64) - 1, U), dtype=U)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        _POWERS[:] = [_power(BASE, n), _power(pow(BASE, -1, 1 << 64), n)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of stretches of one buffer."""

    def __init__(self, data: np.ndarray):
        """data: bytes, or 64-bit values of other symbols."""
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data if data.dtype == U else BYTE_VALUE[data]) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, k: int) -> np.ndarray:
        """Of every stretch of k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def slices(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    release()
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of some texts: bytes ``starts`` to ``ends`` in ``data``, their hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.data = LOWER[raw] if lower else raw
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = ~SPACE[raw]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = Rolling(self.data).of(self.starts, self.ends) + (self.ends - self.starts).astype(U)
        return self._hashes

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that run on into the next text mean nothing."""
        n = max(len(self.hashes) - k + 1, 0)
        out = np.zeros(n, U)
        for j in range(k):
            out += self.hashes[j : j + n] * WORD_FACTOR[j]
        return mix(out, k)


def _stretches(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts of about ``most`` bytes that end before white space, so that no word is in two."""
    begin = 0
    while len(text) - begin > most:
        gap = _GAP.search(text, begin + most)
        if not gap:
            break
        yield text[begin : gap.start()]
        begin = gap.start()
    yield text[begin:]


def word_arrays(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, first bytes and ends of the words of each text; equal words have equal hashes wherever they are."""
    for a, b in slices(texts, most):
        if b - a == 1 and len(texts[a]) > most:
            offset, found = 0, []
            for part in _stretches(texts[a], most):
                words = Words([part])
                found.append((words.hashes, words.starts + offset, words.ends + offset))
                offset += len(part)
            yield tuple(map(np.concatenate, zip(*found)))
            continue
        words = Words(texts[a:b])
        for k in range(b - a):
            at = slice(int(words.first[k]), int(words.first[k + 1]))
            yield words.hashes[at], words.starts[at] - words.offsets[k], words.ends[at] - words.offsets[k]
