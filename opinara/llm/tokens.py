"""Word hashes of many texts at once, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

_U = np.uint64
#: Texts are handled together until they hold this many bytes; a longer text is handled alone, and whole.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, CHUNK + 4096), b, _U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of a chunk in text order: their text's number, places in ``data`` and hash."""

    data: np.ndarray
    sums: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of other stretches of the data."""
        return mix((self.sums[end] - self.sums[start]) * _upto(len(self.data) + 1)[1][start] + (end - start).astype(_U))


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, UTF-8 texts) by about CHUNK bytes; null is empty."""
    at, own, size = 0, [], 0
    for k, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if own and size + len(raw) > CHUNK:
            yield at, own
            at, own, size = k, [], 0
        own.append(raw)
        size += len(raw) + 1
    if own:
        yield at, own


def split(raw: list[bytes], letters: bool = False) -> Words:
    """Words of UTF-8 texts, A-Z as a-z: runs between ASCII white space, or with ``letters`` runs of ASCII letters and
    digits and of all other characters beyond ASCII."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    if letters:
        inside = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    else:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    power, _ = _upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    first = np.cumsum([0] + [len(r) + 1 for r in raw])
    doc = np.searchsorted(first, start, "right") - 1
    words = Words(data, sums, doc, start, end, np.empty(0, _U))
    return words._replace(hash=words.part(start, end))


def shingles(words: Words, n_docs: int, k: int) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct hashes of its runs of k words; of its whole sequence if it has fewer."""
    count = np.bincount(words.doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))
    odd = mix(np.arange(1, k + 1, dtype=_U)) | _U(1)
    size = max(0, len(words.hash) - k + 1)
    runs = np.zeros(size, _U)
    for j in range(k):
        runs += words.hash[j : j + size] * odd[j]
    runs = mix(runs)
    for d in range(n_docs):
        n, at = int(count[d]), int(first[d])
        if n >= k:
            yield np.unique(runs[at : at + n - k + 1])
        elif n:
            yield mix(np.array([(words.hash[at : at + n] * odd[:n]).sum(dtype=_U) + _U(n)], _U))
        else:
            yield np.empty(0, _U)
