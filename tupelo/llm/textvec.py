"""Words, lines and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

A text's words are its longest runs without white space, [^\\x20\\x09-\\x0D]+. The hash of the
bytes s..e is a polynomial mod 2^64, read off prefix sums: (S[e] - S[s]) * P^-s. Its multiplier
is odd and so has an inverse. Hashes go through a mixing step, as polynomials mod 2^64 have weak
low bits. Long spans are hashed by XXH64 instead: some long texts collide under every such
polynomial. Where equal hashes must mean equal bytes, unequal() tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_IP = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that start a character.
HEAD = (np.arange(256) & 0xC0) != 0x80
#: Spans of more items than this are hashed by XXH64.
LONG = 256

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Texts:
    """Some texts: data, their bytes; at, where each starts, and the end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums from which spans() hashes; of other bytes in the same places, if given."""
        data = self.data if data is None else data
        s = np.empty(len(data) + 1, U64)
        s[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * powers(_P, len(data)), out=s[1:])
        return s

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """The hash of each span start..end; prefix: of data, by default of the texts' own."""
        data = self.data if data is None else data
        out = mix((prefix[end] - prefix[start]) * powers(_IP, len(prefix))[start])
        for k in np.flatnonzero(end - start > LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(np.ascontiguousarray(data[start[k] : end[k]]).tobytes(), 42)
        return out

    def unequal(self, start: np.ndarray, end: np.ndarray, other: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Which spans start..end differ in any byte from other..until."""
        size = end - start
        out = size != until - other
        same = np.flatnonzero(~out & (start != other))
        for part in np.array_split(same, 1 + int(size[same].sum()) // (4 << 20)):
            n = size[part]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differs = self.data[np.repeat(start[part], n) + within] != self.data[np.repeat(other[part], n) + within]
            out[part] = np.bincount(np.repeat(np.arange(len(part)), n), differs, len(part)) > 0
        return out

    def words(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and the number of words before each text (and of all); inside: what
        belongs to words, if not all but white space."""
        inside = ~SPACE[self.data] if inside is None else inside
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        full = self.at[:-1][self.at[1:] > self.at[:-1]]
        first[full] = inside[full]
        end = self.at[1:][self.at[1:] > self.at[:-1]] - 1
        last[end] = inside[end]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(start, self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of \\n-split lines, and the number of lines before each text."""
        cuts = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.at[:-1], cuts + 1]))
        end = np.sort(np.concatenate([self.at[1:], cuts]))
        count = np.diff(np.searchsorted(cuts, self.at)) + 1
        return start, end, np.concatenate([[0], np.cumsum(count)])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes of each text have the flag."""
        s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return s[self.at[1:]] - s[self.at[:-1]]


def owner(before: np.ndarray) -> np.ndarray:
    """The text of each item, from the number of items before each text."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and where each value starts; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts): a batch in parts of about so many bytes, a text never cut."""
    data, at = bytes_of(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, Texts(data[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


def ngram_sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of each text's items (rows of values), 0 for texts without any."""
    out = np.zeros((len(before) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(before))
    if len(full):
        out[full] = np.add.reduceat(values, before[full], axis=0, dtype=np.float64)
    return out
