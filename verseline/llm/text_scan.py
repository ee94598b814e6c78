"""Vectorised word scanning and hashing over Arrow string columns.

Everything here works on the raw UTF-8 buffer of an Arrow array, so no Python
string is made per row.  Work is cut into slices of whole rows of at most
``SLICE_BYTES`` (a longer row is a slice of its own), which bounds memory by
the slice size or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C55)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _BASE)


_WORD_CODES = stream64(64, 8) | np.uint64(1)
_BYTE_CODES = stream64(256, 7)
_places = [stream64(256, 9) | np.uint64(1)]
#: the low bytes of a 64-bit number, by how many
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: bytes of a word that are hashed eight at a time
SHORT = 64


def _place_codes(n: int) -> np.ndarray:
    """A random odd factor for each place in a word."""
    if len(_places[0]) < n:
        _places[0] = stream64(2 * n, 9) | np.uint64(1)
    return _places[0]


def word_codes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words in a byte buffer.

    Eight bytes at a time go through a mixing function that is one-to-one in
    them, so words agree by chance only and not by their make-up, as they do under
    a polynomial.  Words of more than SHORT bytes are sums of their bytes' codes
    times independent random factors for their places.
    """
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf), "<u8", padded, strides=(1,))
    out = mix64(sizes.astype(np.uint64) * _BASE)
    active, at, left = np.arange(len(starts)), starts, sizes
    for _ in range(0, SHORT, 8):
        if not len(active):
            break
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        out[active] = mix64(out[active] ^ part)
        more = np.flatnonzero(left > 8)
        active, at, left = active[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        size = sizes[long]
        stop = np.cumsum(size)
        place = np.arange(stop[-1]) - np.repeat(stop - size, size)
        total = np.zeros(stop[-1] + 1, np.uint64)
        np.cumsum(_BYTE_CODES[buf[place + np.repeat(starts[long], size)]] * _place_codes(int(size.max()))[place], out=total[1:])
        out[long] = mix64(total[stop] - total[stop - size])
    return out


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_binary()), np.int64
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (lo, hi) whose texts hold at most ``most`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: words are runs of anything but ASCII white space
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
#: words are runs of ASCII letters, digits and any non-ASCII character
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of some texts: byte places, hashes, and for each text its words' range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, members: np.ndarray):
        first, last = int(offsets[0]), int(offsets[-1])
        buf, offs = data[first:last], offsets - first
        n = len(buf)
        inside = members[buf]
        flag = np.zeros(n + 1, bool)
        flag[1:n] = inside[1:] & ~inside[:-1] if n else False
        cuts = offs[:-1][offs[:-1] < n]
        flag[cuts] = inside[cuts]
        self.starts = np.flatnonzero(flag)
        flag[:] = False
        flag[1:n] = inside[:-1] & ~inside[1:] if n else False
        flag[n] = bool(n) and inside[n - 1]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        flag[cuts] = inside[cuts - 1]
        self.ends = np.flatnonzero(flag)
        self.hashes = word_codes(LOWER[buf], self.starts, self.ends - self.starts)
        #: text i has the words bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words.

    A text with fewer words has one shingle, its whole word sequence; one without words has none.
    """
    h, bounds = words.hashes, words.bounds
    n = max(0, len(h) - size + 1)
    whole = np.zeros(n, np.uint64)
    for i in range(size):
        whole += h[i : n + i] * _WORD_CODES[i]
    whole = mix64(whole)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(whole[lo : hi - size + 1]))
        elif hi > lo:
            few = (h[lo:hi] * _WORD_CODES[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix64(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
