"""Vectorised word and shingle hashing over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The characters \\x20 and \\x09-\\x0D separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A word for each byte at each of the first places of a word; drawn, so that no structure of texts meets another in them.
_PLACES = 64
_DRAWN = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each text and the total).

    Words are the maximal runs without \\x20 and \\x09-\\x0D, with A-Z lower-cased.  A word's
    hash is mixed from the sum of what is drawn for each of its bytes at its place, so two
    different words hash alike with a chance of about 2 ** -64, whatever their structure.
    """
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, stop = edge[0::2], edge[1::2]
    size = stop - start
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    place = at - np.repeat(start, size)
    v = _DRAWN.take(((place & (_PLACES - 1)) << 8) | raw.take(at))
    with np.errstate(over="ignore"):
        if len(size) and size.max() > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            v[far] = mix(v[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        h = mix(np.add.reduceat(v, np.cumsum(size) - size)) if len(size) else np.zeros(0, np.uint64)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return h, np.searchsorted(start, begins)


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word shingles, first shingle of each text and the total).

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    h, first = word_hashes(texts)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begins = np.concatenate([[0], np.cumsum(count)])
    if not begins[-1]:
        return np.zeros(0, np.uint64), begins
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], count)
    left = np.repeat(np.minimum(n, k), count)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        s = left.astype(np.uint64)
        for j in range(k):
            w = padded[at + j]
            s = mix(s + np.where(j < left, w, np.uint64(0)))
    return s, begins


def slices(batch: pa.RecordBatch, column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``size`` bytes in ``column``, to bound what is unpacked at once."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, some texts) with about ``size`` bytes each time."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield begin, texts[begin : i + 1]
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]
