"""Vectorised helpers on UTF-8 texts that arrive as Arrow arrays.

All helpers work on whole texts. A batch is cut into blocks of a few MB so that
the temporary arrays stay in cache and in memory; a single text longer than a
block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_SEED = 0x2545F4914F6CDD1D
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
SHORT = 7

#: Words end at space and at 0x09 to 0x0D.
SPACES = np.ones(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are runs of 0-9, a-z and bytes of characters beyond ASCII; A-Z count once lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and len + 1 offsets into them. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts of about ``limit`` bytes."""
    data, at = flat(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (one entry more than texts)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts - 1]]
    first[joined] = True
    last[joined - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _MUL, np.uint64), np.full(n, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the factors that shift a difference of two of them to its place.

    Some strings are known to collide under it, so it serves only where equal hashes are compared in full afterwards.
    """
    up, down = _powers(max(12, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes.

    Words of up to ``SHORT`` bytes never collide with one another: their bytes and their number fit into 64 bits, which a
    bijection mixes. Longer ones are hashed one by one by a keyed hash that can't be run backwards.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    few = np.minimum(size, SHORT)
    out = mix(((eight[starts] & _FIRST_BYTES[few]) | few.astype(np.uint64) << np.uint64(56)) + np.uint64(_SEED))
    far = np.flatnonzero(size > SHORT)
    if len(far):
        raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        out[far] = np.array([digest(raw[a:z], _SEED) for a, z in zip(starts[far].tolist(), ends[far].tolist(), strict=True)], np.uint64)
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each of ``starts`` are those from each of ``others``."""
    at = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(at[-1]) - np.repeat(at[:-1], size)
    wrong = data[np.repeat(starts, size) + step] != data[np.repeat(others, size) + step]
    return np.diff(np.concatenate([[0], np.cumsum(wrong)])[at]) == 0


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words with one space between them, and len + 1 offsets into that."""
    size = ends - starts + 1
    last = first[1:][np.diff(first) > 0] - 1
    size[last] -= 1
    at = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    out = np.append(data, np.uint8(0x20))[where]
    between = np.ones(len(size), bool)
    between[last] = False
    out[at[1:][between] - 1] = 0x20
    return out, at[first]


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` words from each position; the caller drops those that cross texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)
