"""Vectorised text helpers for Arrow batches: words, word hashes and per-document sums.

A text column is handled as one byte buffer with document offsets, so no Python
object is made for a word. Words are ``[^\\x20\\x09-\\x0D]+``: maximal runs of
bytes that are not ASCII white space (UTF-8 keeps those bytes for themselves).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
PIECE = 1 << 18
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (all bits depend on all bits)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE) + 1
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = tables
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (from 0) of a string column; a null counts as an empty text."""
    arr = column.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=arr.offset + n + 1)[arr.offset :]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word offsets of the documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = np.zeros(n + 2, dtype=bool)
    np.logical_not(IS_SPACE[data], out=word[1:-1])
    cut = np.zeros(n + 1, dtype=bool)  # a document starts here
    cut[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, to deal spans out by; unequal spans may share one, so it decides no match.

    Works through the buffer in pieces of whole words, so memory stays a small
    multiple of ``PIECE`` (or of the longest word).
    """
    table = _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        hi = ends[j - 1]
        power, inverse = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (xxh3, once for each distinct word of a piece); ``fold`` reads A-Z as a-z.

    Works through the buffer in pieces of whole words, so memory stays a small
    multiple of ``PIECE`` (or of the longest word).
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        part = data[lo : ends[j - 1]]
        if fold:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        codes, words = word_codes(part, starts[i:j] - lo, ends[i:j] - lo)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, 20240131) for w in words.to_pylist()), np.uint64, len(words))
        out[i:j] = hashes[codes]
        i = j
    return out


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word as a code into the distinct words (exact, by Arrow's dictionary encoding)."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    cuts = np.empty(2 * len(starts), dtype=np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    spans = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]
    )  # word, gap, word, gap, ..., word
    coded = spans.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
    used = np.bincount(codes, minlength=len(coded.dictionary)) > 0  # the gaps are in the dictionary too
    return (np.cumsum(used) - 1)[codes], coded.dictionary.filter(pa.array(used))


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every ``k`` consecutive hashes (empty if there are fewer than ``k``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    multiplier = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x2545F4914F6CDD1D) % 2**64 | 1)
    out = np.full(n, seed, dtype=np.uint64)
    for j in range(k):
        out = out * multiplier + h[j : j + n]
    return mix(out)


def per_document(values: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word or byte) for each document."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[word_offsets[1:]] - sums[word_offsets[:-1]]


def documents_of(word_offsets: np.ndarray) -> np.ndarray:
    """The document index of each word."""
    return np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))


def slices(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most_bytes`` of text; a longer text is alone in its run."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    give_back()


def blocks(batches: Iterator[pa.RecordBatch], text: str, least_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in blocks that end once they hold ``least_bytes`` of text (the last may hold less)."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, text, least_bytes):
            held.append(part)
            size += int(buffers(part[text])[1][-1])
            if size >= least_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    del held
    give_back()


def give_back() -> None:
    """Return free memory to the system: an idle Python worker otherwise keeps the most that it ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)
