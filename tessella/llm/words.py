"""Words, their hashes and word n-gram hashes of whole Arrow text columns, as NumPy vectors.

A word is ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes.  Texts are taken in runs of whole documents of
about ``RUN_BYTES``, so memory follows the run (or the longest single document), not the batch.
Hashes are 64-bit polynomials over a random byte table, finished by a mixer: equal words always
agree, and two different words of one corpus collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_U = np.uint64


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII that is neither letter nor digit: words without punctuation.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
EXACT = _table(11)
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, RUN_BYTES + 1)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 8 * RUN_BYTES:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Run:
    """Some whole documents.  ``first``: index of the first; ``bounds``: words of document d are
    ``bounds[d]:bounds[d+1]``; ``start``/``end``: byte span of each word in ``data``; ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, sep: np.ndarray, table: np.ndarray):
        self.data, self.first, self.offsets = data, first, offsets
        n = len(data)
        word = ~sep[data]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = word
        before[offsets[:-1]] = False
        after = np.empty(n + 1, bool)
        after[:n] = word
        after[n] = False
        after[offsets[1:]] = False
        self.start = np.flatnonzero(word & ~before[:n])
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * _power(_BASE, n)[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _power(_INV, n + 1)[self.start])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owner(self) -> np.ndarray:
        """For each word, its document (0-based in this run)."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def grams(self, k: int, factor: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows at every word, and which of them lie in one document.
        Another odd ``factor`` gives an independent hash."""
        h, n = self.hash, len(self.hash)
        m = max(0, n - k + 1)
        out = np.zeros(n, np.uint64)
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc = acc * _U(factor) + h[j : j + m]
        out[:m] = mix(acc)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return out, np.arange(n) + k <= ends

    def text(self, i: int, j: int) -> bytes:
        """The bytes from the first of words i..j-1 to the last."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes()


def runs(texts: pa.Array, sep: np.ndarray = SPACE, table: np.ndarray = EXACT) -> Iterator[Run]:
    """Runs over a string column; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    _, offs, body = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1
        j = min(n, max(j, i + 1))
        yield Run(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, sep, table)
        i = j
