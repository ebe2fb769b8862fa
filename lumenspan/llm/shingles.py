"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes hashed at a time; a longer text is cut between two words.
BLOCK = 1 << 20
_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_LANE = _rng.integers(0, 1 << 64, 8, np.uint64) | np.uint64(1)
_BASE = int(_LANE[7])
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's position of every word; a word's hash depends on its bytes alone, A-Z lowered."""
    b = np.frombuffer(data, np.uint8)
    gap = np.concatenate(([True], _SPACE[b], [True]))
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2], turn[1::2]
    up, down = _power(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[b]] * up[: len(b)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _LANE[6]), start


def _parts(texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
    for k, text in enumerate(texts):
        data = text.encode()
        at = 0
        while len(data) - at > BLOCK:
            cut = at + BLOCK
            while cut < len(data) and not _SPACE[data[cut]]:
                cut += 1
            yield k, data[at:cut]
            at = cut
        yield k, data[at:]


def words_of(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, in order."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    held, size = [], 0

    def flush() -> None:
        h, start = word_hashes(b" ".join(d for _, d in held))
        edges = np.searchsorted(start, np.cumsum([0, *(len(d) + 1 for _, d in held)]))
        for (k, _), a, z in zip(held, edges[:-1], edges[1:], strict=True):
            found[k].append(h[a:z])

    for k, data in _parts(texts):
        if held and size + len(data) > BLOCK:
            flush()
            held, size = [], 0
        held.append((k, data))
        size += len(data)
    if held:
        flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of `width` words of each text, sorted; with fewer words the whole sequence is one."""
    out = []
    for w in words_of(texts):
        k = min(width, len(w))
        if not k:
            out.append(w)
            continue
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = mix(h + w[i : i + n] * _LANE[i % 6]) if i >= 5 else h + w[i : i + n] * _LANE[i]
        h = np.sort(mix(h))
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that tell sets apart."""
    a, b = shingles.sum(dtype=np.uint64), mix(shingles ^ _LANE[5]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
