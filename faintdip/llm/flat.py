"""Vectorised kernels over flat text: a column of strings as one byte array with offsets.

Every kernel takes whole texts (null counts as empty), works on slices of bounded size, and
never lets a word, line or window cross two texts.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one text above it is a slice of its own.
SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def powers(n: int, side: str) -> np.ndarray:
    """BASE**i (side up) or its inverse (down) modulo 2**64, for i below n."""
    have = _powers[side]
    if len(have) < n:
        size = max(n, 2 * len(have), SLICE)
        step = np.full(size, BASE if side == "up" else BASE_INV, np.uint64)
        step[0] = 1
        have = _powers[side] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary(column) -> pa.Array:
    """A string or binary Arrow column as one large_binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def release() -> None:
    """Gives back what Arrow and malloc keep of freed arrays: workers are reused, and while they wait it would count against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


def slices(column, limit: int = SLICE):
    """Yield (first row, bytes, offsets) for runs of rows with about limit bytes."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    release()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers of BASE; n + 1 values. Good enough to choose places by, not to tell texts apart."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * powers(len(buf), "up"), out=out[1:])
    return out


#: Ranges of more bytes than this are hashed one by one.
LONG = 256
_FACTORS = tuple(np.uint64(x | 1) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [start, end), whatever its place.

    Eight bytes at a time go through a bijection of the state, so equal lengths of up to eight
    bytes never collide, and longer ranges by chance only, whatever structure the bytes have.
    """
    size = np.asarray(end - start, np.int64)
    out = mix(size.astype(np.uint64) * _FACTORS[0] + np.uint64(1))
    if not len(size):
        return out
    wide = np.flatnonzero(size > LONG)
    for k in wide.tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    chunk = np.ndarray(len(buf) + 1, "<u8", pad.data, 0, (1,))
    at, left = np.asarray(start, np.int64), np.where(size > LONG, 0, size)
    live = None  # all, in the first round
    while True:
        if live is None or not (left > 0).all():
            some = np.flatnonzero(left > 0)
            live = some if live is None else live[some]
            at, left = at[some], left[some]
        if not len(live):
            return out
        x = chunk[at].astype(np.uint64)
        last = left < 8
        x[last] &= (np.uint64(1) << (left[last].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        out[live] = mix((out[live] ^ mix(x + _FACTORS[1])) * _FACTORS[2])
        at, left = at + 8, left - 8


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words [^\\x20\\x09-\\x0D]+."""
    ink = ~WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:-1]
    stops = ink.copy()
    stops[:-1] &= ~ink[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(off, start, "right") - 1


def neighbours(text: np.ndarray, n: int) -> np.ndarray:
    """Which words begin a run of n words of one text."""
    if len(text) < n:
        return np.zeros(0, bool)
    return text[n - 1 :] == text[: len(text) - n + 1]


def shingle_hash(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes."""
    m = len(word) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word[i : i + m] + np.uint64(i + 1))
    return out


def repeated(key: np.ndarray) -> np.ndarray:
    """Marks the values that occur more than once."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        eq = k[1:] == k[:-1]
        same[1:] = eq
        same[:-1] |= eq
    out = np.empty(len(key), bool)
    out[order] = same
    return out


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
