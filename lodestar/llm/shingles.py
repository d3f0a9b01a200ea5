"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20)
BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64."""
    global _powers
    while len(_powers) < n:
        with np.errstate(over="ignore"):
            last = _powers[-1] * ODD[0]
            _powers = np.concatenate([_powers, _powers * last])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of all words where there are fewer."""
    return [s for s, _, _ in ranked_sets(texts, k, None)]


def ranked_sets(texts: list[str], k: int, table: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """shingle_sets, each element's least word frequency in ``table`` (by the low bits of the word's hash), and all words' hashes."""
    parts = [t.encode("utf-8", "replace").lower() for t in texts]
    x = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    ends_of_text = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    inside = ~SPACE[x]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [(none, np.zeros(0, np.int64), none) for _ in texts]
    with np.errstate(over="ignore"):
        at = np.flatnonzero(inside)
        lengths = ends - starts
        begin = np.cumsum(lengths) - lengths
        within = np.arange(len(at)) - np.repeat(begin, lengths)
        value = BYTE[x[at]] * powers(int(lengths.max()))[within]
        words = mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64))
        chain = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            chain += words[j : j + len(chain)] * ODD[1 + j]
        chain = mix(chain)
        least = None
        if table is not None:
            seen = table[words & np.uint64(len(table) - 1)].astype(np.int64)
            least = seen[: len(chain)].copy()
            for j in range(1, k):
                np.minimum(least, seen[j : j + len(chain)], out=least)
        stop = np.searchsorted(starts, ends_of_text)
        first = np.concatenate([[0], stop[:-1]])
        out = []
        for a, b in zip(first.tolist(), stop.tolist(), strict=True):
            rank = None
            if b - a >= k:
                if least is None:
                    s = np.unique(chain[a : b - k + 1])
                else:
                    s, where = np.unique(chain[a : b - k + 1], return_index=True)
                    rank = least[a : b - k + 1][where]
            elif b > a:
                s = mix(np.array([(words[a:b] * ODD[20 : 20 + b - a]).sum() + np.uint64(b - a)], np.uint64))
                rank = np.zeros(1, np.int64)
            else:
                s, rank = none, np.zeros(0, np.int64)
            out.append((s, rank, words[a:b]))
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ ODD[40]).sum() + np.uint64(len(s))], np.uint64)).astype(np.int64)[0])


def set_check(s: np.ndarray) -> int:
    """A second key of a set, with nothing in common with set_key."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ ODD[42]).sum() ^ np.uint64(len(s))], np.uint64)).astype(np.int64)[0])
