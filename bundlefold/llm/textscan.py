"""Words of whole texts and their 64-bit hashes, found with numpy over the bytes of a batch.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2**64, then mixed; it is the same on
every machine. Two words of a corpus share a hash with a chance of about pairs / 2**64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_power = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", _PRIME), ("down", _INVERSE)):
                steps = np.full(size, base, U)
                steps[0] = 1
                _power[key] = np.cumprod(steps, dtype=U)
    return _power["up"][:n], _power["down"][:n]


@lru_cache
def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z only) and which bytes belong to words.

    alnum: words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text. space: words [^\\x20\\x09-\\x0D]+."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.ones(256, bool)
    if kind == "alnum":
        word[:128] = False
        word[48:58] = word[97:123] = word[65:91] = True
    else:
        word[[0x20, *range(0x09, 0x0E)]] = False
    return low, word


#: Bytes hashed in one step.
CHUNK = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Hashes of stretches of bytes that don't overlap and are in order; low maps bytes before they are hashed."""
    out, lo, n = np.empty(len(starts), U), 0, len(starts)
    with np.errstate(over="ignore"):
        while lo < n:
            a = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(starts, a + CHUNK)))
            b = int(ends[hi - 1])
            up, down = _powers(b - a + 1)
            total = np.zeros(b - a + 1, U)
            part = data[a:b] if low is None else low[data[a:b]]
            np.cumsum(_BYTE[part] * up[:-1], dtype=U, out=total[1:])
            s, e = starts[lo:hi] - a, ends[lo:hi] - a
            out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            lo = hi
    return out


class Words:
    """The words of a batch: starts and ends in the batch's bytes, and first, the n + 1 offsets of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str):
        low, word = _tables(kind)
        self.data, self.offsets = data, offsets
        w = word[data]
        before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        at = offsets[:-1][offsets[:-1] < len(w)]
        before[at] = False
        at = offsets[1:][offsets[1:] > 0]
        after[at - 1] = False
        self.starts, self.ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.low = low

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, self.low)

    def tails(self, n: int) -> np.ndarray:
        """The last n bytes (fewer in shorter words) of each word, as one number; n is at most 7."""
        out = (np.minimum(self.ends - self.starts, n)).astype(U)
        for k in range(1, n + 1):
            at = np.maximum(self.ends - k, self.starts)
            out = (out << U(8)) | np.where(self.ends - k >= self.starts, self.low[self.data[at]], 0).astype(U)
        return out


def word_hash(word: bytes) -> int:
    """One word's hash, as in Words.hashes."""
    data = np.frombuffer(word, np.uint8)
    w = Words(data, np.array([0, len(data)]), "space")
    w.starts, w.ends = np.array([0]), np.array([len(data)])
    return int(w.hashes()[0])


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text, with n + 1 offsets. A text of fewer words, but not none, has one
    shingle of all its words."""
    counts = np.diff(first)
    n_sh = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offs = np.concatenate([[0], np.cumsum(n_sh)])
    begin = np.repeat(first[:-1] - offs[:-1], n_sh) + np.arange(offs[-1])
    end = np.minimum(begin + size, np.repeat(first[1:], n_sh))
    with np.errstate(over="ignore"):
        out = np.zeros(len(begin), U)
        for k in range(size):
            at = begin + k
            ok = at < end
            step = hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else out
            out = np.where(ok, mix(out * U(_PRIME) + step + U(k + 1)), out)
    return out, offs


def sequence_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole word sequence."""
    counts = np.diff(first)
    keys = []
    with np.errstate(over="ignore"):
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
            x = mix(mix(hashes ^ U(salt)) + place.astype(U) * U(_PRIME))
            total = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
            keys.append(mix(total[first[1:]] - total[first[:-1]] + counts.astype(U)))
    return keys[0], keys[1]
