"""Whole Arrow batches as words and hashes, by array operations instead of per-document Python."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Keeps the lowest 0 to 8 bytes of eight.
LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of pairs in order: a non-linear step, so no pattern of repeated parts cancels out."""
    with np.errstate(over="ignore"):
        return mix(left * U(0xD6E8FEB86659FD93) + right, 5)


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by their first: halves are joined, so log2(k) steps serve."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width, out, have = values, 1, None, 0
    while True:
        if k & width:
            out = part[:n] if out is None else joined(out, part[have : have + n])
            have += width
        if have == k:
            return out
        part = joined(part[:-width], part[width:])
        width *= 2


def eight_bytes(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``padded`` ends with eight more bytes."""
    return np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def hashes_of(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits for each byte range: a keyed non-linear step for every eight bytes, BLAKE2 for long ones."""
    size = ends - starts
    out = mix(size.astype(np.uint64), 1 + 16 * salt)
    eight, live, at = eight_bytes(padded), np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        block = eight[starts[live] + at] & LOW_BYTES[left]
        out[live] = mix(out[live] ^ block, 2 + at)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"%d" % salt).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string array; a null text has none. ``space``: the bytes between words.

    starts, ends: byte ranges in ``bytes``; first: for each row, the index of its first word
    (one more entry ends the last row); hash: 64 bits for each word. Nothing outlives the batch.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE):
        n = len(texts)
        if pa.types.is_string(texts.type):
            kind = np.int32
        elif pa.types.is_large_string(texts.type):
            kind = np.int64
        else:
            texts, kind = texts.cast(pa.string()), np.int32
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        self.padded = np.zeros(len(raw) + 8, np.uint8)
        if lower:
            np.take(LOWER, raw, out=self.padded[: len(raw)])
        else:
            self.padded[: len(raw)] = raw
        self.bytes = self.padded[: len(raw)]
        solid = ~space[raw]
        edge = solid.copy()
        full = self.offsets[1:] > self.offsets[:-1]
        if len(raw):
            edge[1:] &= ~solid[:-1]
            heads = self.offsets[:-1][full]
            edge[heads] = solid[heads]
        self.starts = np.flatnonzero(edge)
        if len(raw):
            edge[:] = solid
            edge[:-1] &= ~solid[1:]
            tails = self.offsets[1:][full] - 1
            edge[tails] = solid[tails]
        self.ends = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hash: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hashes_of(self.padded, self.starts, self.ends)
        return self._hash

    def other_hash(self) -> np.ndarray:
        """A second hash of each word, independent of ``hash``."""
        return hashes_of(self.padded, self.starts, self.ends, 1)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def room(self, k: int) -> np.ndarray:
        """First words of all runs of k words within one row."""
        last = np.repeat(self.first[1:], self.counts)
        last -= np.arange(len(last))
        return np.flatnonzero(last >= k)

    def windows(self, k: int, salt: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of k words within one row, and the runs' hashes."""
        starts = self.room(k)
        every = runs(mix(self.hash if hashes is None else hashes, 3 + salt), k)
        return starts, every[starts]

    def whole(self, rows: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of all words of each of ``rows``, in steps as many as their longest has words."""
        out, count = mix(self.counts[rows].astype(np.uint64), 40 + salt), self.counts[rows]
        for j in range(int(count.max(initial=0))):
            live = count > j
            out[live] = joined(out[live], self.hash[self.first[rows[live]] + j])
        return out

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text, so memory follows the longest row.

    At the end the worker gives freed memory back, as it stays for later tasks of other operators.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        at = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            hi = min(hi, batch.num_rows, lo + 20_000)
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def release() -> None:
    """Returns freed memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass
