"""Vectorised work on the bytes of a batch of texts: words, rolling hashes, windows.

All texts of a batch lie in one byte array. With S[i] the sum of byte j times
p**j for j < i, modulo 2**64, the hash of bytes s..e is (S[e] - S[s]) * p**-s,
so any substring's hash is a few array operations; a finaliser mixes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 2**64))
#: [\x20\x09-\x0D] separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters, digits and every byte of other characters are parts of plain words.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**j and p**-j for j < n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        for name, p in (("up", P), ("down", P_INV)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string array (null: empty), and n + 1 offsets into them."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def batches(texts: pa.Array, most: int = 4 << 20):
    """Slices (i, j) of texts with at most `most` bytes each, or of one text."""
    _, at = flat(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[:-1] + up[:-1], out=out[1:])
    return out


def hashes(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mixed hashes of the bytes s..e of each span."""
    _, down = powers(len(sums))
    return mix((sums[e] - sums[s]) * down[s])


def words(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the n + 1 offsets of each text's words."""
    inner = np.zeros(len(data) + 2, np.int8)
    inner[1:-1] = ~apart[data]
    step = np.diff(inner)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(at) > 2 and len(starts):
        cuts = at[1:-1]  # a word doesn't cross the end of a text
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[(inner[cuts] == 1) & (inner[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, at, "left") if len(data) else np.zeros(len(at), np.int64)


def word_hashes(texts: pa.Array, lower: bool = True, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets of each text's words."""
    data, at = flat(texts)
    if lower:
        data = LOWER[data]
    starts, ends, own = words(data, at, apart)
    return hashes(prefix_sums(data), starts, ends), own


def shingle_sets(texts: pa.Array, k: int):
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words the whole sequence is one; none without words."""
    h, own = word_hashes(texts)
    for i in range(len(texts)):
        w = h[own[i] : own[i + 1]]
        n = max(1, len(w) - k + 1) if len(w) else 0
        if not n:
            yield w
            continue
        out = np.full(n, np.uint64(len(w) if len(w) < k else k), np.uint64)
        for j in range(min(k, len(w))):
            out = mix(out * P + w[j : j + n])
        yield np.unique(out)
