"""Vectorised helpers over UTF-8 bytes of many documents at once: words, hashes, runs.

Documents are laid end to end in one byte array, each followed by one line feed, so a single numpy pass serves a
whole group. Groups are cut at ``GROUP_BYTES``; a longer document is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Expected bytes of a group. Hashes of every place take some hundred times as much memory in each Python worker.
GROUP_BYTES = 1 << 19
U = np.uint64
#: Primes below 2 ** 31 and bases: a letter times a power has 40 bits, so a sum of 2 ** 23 of them fits 64.
_FIELDS = ((2147483647, 1267650607), (2147483629, 779458963))
_SUM_PLACES = 1 << 23
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates are kept apart."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def groups(texts: Iterable[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, bytes, starts)`` of consecutive texts; text i of a group lies at starts[i] .. starts[i+1]-1."""
    texts = list(texts)
    first = 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) < limit):
            size += len(texts[end]) + 1
            end += 1
        part = texts[first:end]
        buf = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        starts = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in part], out=starts[1:])
        yield first, end, buf, starts
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, at least n."""
    have = _powers.get(prime)
    if have is None or len(have[0]) < n:
        have = tuple(np.ones(1, dtype=np.uint64) for _ in range(2))
        for k, step in enumerate((base, pow(base, -1, prime))):
            row = have[k]
            while len(row) < n:
                row = np.concatenate([row, row * U(pow(step, len(row), prime)) % U(prime)])
            have = (row, have[1]) if k == 0 else (have[0], row)
        _powers[prime] = have
    return have


def _prefix_sums(values: np.ndarray, prime: int) -> np.ndarray:
    """Sums up to each place, equal to the true ones modulo the prime; no sum leaves 64 bits."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    for k in range(0, len(values), _SUM_PLACES):
        part = values[k : k + _SUM_PLACES]
        np.cumsum(part, out=sums[k + 1 : k + 1 + len(part)])
        sums[k + 1 : k + 1 + len(part)] += sums[k] % U(prime)
    return sums


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` for every pair: polynomials modulo two primes by prefix sums, then mixed.
    (A polynomial modulo a power of two is the same for some unequal words of 1024 bytes, whatever its base.)"""
    letters, h = buf.astype(np.uint64) + U(1), (ends - starts).astype(np.uint64)
    for prime, base in _FIELDS:
        up, down = _power(len(buf) + 1, prime, base)
        sums = _prefix_sums(letters * up[: len(buf)], prime)
        apart = (sums[ends] % U(prime) + U(prime) - sums[starts] % U(prime)) * down[starts] % U(prime)
        h = mix(h * U(0x9E3779B97F4A7C15) + apart)
    return h


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
