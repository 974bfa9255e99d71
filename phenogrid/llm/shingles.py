"""Word shingles as 64-bit hashes, computed over whole Arrow batches with numpy."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ORDER = np.array([(0xBF58476D1CE4E5B9 * (2 * i + 1) ** 3 | 1) & _MASK for i in range(64)], np.uint64)
#: Bytes hashed at once: arrays of eight bytes for each stay in a core's cache, and a worker holds few of them.
_PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of lower-cased text."""
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
    h = (total[last] - total[first]) * inverse[first]
    return mix(h ^ ((last - first).astype(np.uint64) << np.uint64(56))), first


def _pieces(data: bytes) -> list[bytes]:
    """A long text in pieces that end at a space, where there is one."""
    out, at = [], 0
    while len(data) - at > _PIECE:
        cut = max(data.rfind(c, at, at + _PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            following = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := data.find(c, at + _PIECE)) >= 0]
            cut = min(following, default=len(data))
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def word_hashes(texts: list[str | None], fold: bytes | None = None) -> list[np.ndarray]:
    """For each text, a hash of each word ([^\\x20\\x09-\\x0D]+ after lower-casing A-Z) in order.

    fold maps the lower-cased text's bytes before it is split.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            h, first = _hash_words(b"\n".join(group))
            ends = np.cumsum([len(x) + 1 for x in group])
            cuts = np.searchsorted(first, ends[:-1])
            out.extend(np.split(h, cuts))
            group.clear()
            size = 0

    for t in texts:
        data = (t or "").encode().lower()
        if fold:
            data = data.translate(fold)
        if len(data) > _PIECE:
            flush()
            out.append(np.concatenate([_hash_words(p)[0] for p in _pieces(data)]))
            continue
        if size + len(data) > _PIECE:
            flush()
        group.append(data)
        size += len(data) + 1
    flush()
    return out


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _ORDER[i]
    return np.unique(mix(total))
