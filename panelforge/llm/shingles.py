"""Sets of word shingles as 64-bit codes, made for whole batches of texts at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=U)
PLACE_CODE = _RNG.integers(0, 2**64, 64, dtype=U) | U(1)
BASE = U(0x9DDFEA08EB382D69)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit codes that makes their bits depend on each other."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, U)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of every word of the texts (A-Z as a-z), one text after the other, and how many words each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    filled = ~BLANK[data]
    edges = np.diff(np.concatenate([[False], filled, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    counts = np.diff(np.concatenate([[0], np.searchsorted(first, ends)]))
    return _digests(LOWER[data], first, last - first), counts


#: Words longer than so many bytes are digested one by one.
LONG = 256


def _digests(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The code of each word: its length and then its bytes, eight at a time, go through a bijection that starts from the last result.

    Unlike sums of powers, which are equal for certain pairs of words whatever their base, this has no known structure. Of
    long words the BLAKE2 digest is taken.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,)) if len(data) else np.zeros(1, U)
    codes = mixed(size.astype(U) * PLACE_CODE[60] ^ PLACE_CODE[61])
    chained = np.flatnonzero(size <= LONG)
    at = 0
    while len(chained):
        left = size[chained] - at
        part = eights[first[chained] + at]
        part = np.where(left < 8, part & ((U(1) << (np.minimum(left, 7) * 8).astype(U)) - U(1)), part)
        codes[chained] = mixed(mixed(codes[chained] ^ part) + PLACE_CODE[62])
        at += 8
        chained = chained[left > 8]
    for k in np.flatnonzero(size > LONG):
        codes[k] = int.from_bytes(blake2b(data[first[k] : first[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
    return codes


def shingle_codes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of every text's shingles, sorted within the text, and how many each text has.

    A text with fewer words than width has its whole sequence as one shingle; one without words has none.
    """
    codes, counts = word_codes(texts)
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[of]
    short = counts[of] < width
    padded = np.concatenate([codes, np.zeros(width, U)])
    total = np.zeros(len(of), U)
    for k in range(width):
        part = mixed(padded[at + k] ^ PLACE_CODE[k])
        part[short & (k >= counts[of])] = PLACE_CODE[width + k]
        total += part * PLACE_CODE[2 * width + k]
    total = mixed(total)
    ends = np.cumsum(n)
    for a, b in zip(ends - n, ends, strict=True):
        total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (of[1:] != of[:-1])
    return total[new], np.bincount(of[new], minlength=len(texts))
