"""Per-document text statistics, vectorised over Arrow batches (used by the quality rules and the classifier)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .text import buffers, documents_of, per_document, word_bounds, word_codes

SYMBOLS = b"#*$%&|<>"


def byte_class(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


IS_SYMBOL = byte_class(SYMBOLS)
IS_UPPER, IS_LOWER, IS_DIGIT = byte_class(range(65, 91)), byte_class(range(97, 123)), byte_class(range(48, 58))
IS_PUNCTUATION = byte_class(b".,;:!?")
STARTS_CHARACTER = byte_class([*range(0x80), *range(0xC0, 0x100)])  # all bytes but UTF-8 continuation bytes


def _equal_neighbours(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and whether each row but the first equals the one before it."""
    if np.prod([float(max(1, s)) for s in sizes]) < 2.0**62:  # one exact number for a row
        key = np.zeros(len(columns[0]), dtype=np.int64)
        for c, s in zip(columns, sizes, strict=True):
            key = key * max(1, s) + c
        order = np.argsort(key)
        key = key[order]
        return order, key[1:] == key[:-1]
    order = np.lexsort(columns[::-1])
    return order, np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])


class Texts:
    """A block of texts; each statistic is an array with one entry per document and is computed only when asked for."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = buffers(column)
        self.starts, self.ends, self.words = word_bounds(self.data, self.offsets)
        self.n_words = np.diff(self.words)
        self.doc = documents_of(self.words)
        self._codes = None

    def count_bytes(self, members: np.ndarray) -> np.ndarray:
        return per_document(members[self.data], self.offsets)

    def word_chars(self) -> np.ndarray:
        """Code points in words: all characters that are not white space."""
        inside = STARTS_CHARACTER.copy()
        inside[[9, 10, 11, 12, 13, 32]] = False
        return self.count_bytes(inside)

    def symbols(self) -> np.ndarray:
        return self.count_bytes(IS_SYMBOL)

    def codes(self) -> tuple[np.ndarray, int]:
        """Each word as a number, equal for equal words and different for others, and how many numbers there are."""
        if self._codes is None:
            codes, distinct = word_codes(self.data, self.starts, self.ends)
            self._codes = codes, max(1, len(distinct))
        return self._codes

    def distinct_words(self) -> np.ndarray:
        codes, _ = self.codes()
        order, same = _equal_neighbours([self.doc, codes], [len(self.n_words), self.codes()[1]])
        d, new = self.doc[order], np.ones(len(order), dtype=bool)
        new[1:] = ~same
        return np.bincount(d[new], minlength=len(self.n_words))

    def repeated_words(self, window: int = 3) -> np.ndarray:
        """Words that lie in a window of ``window`` words found twice or more in the same text, all occurrences counted."""
        codes, distinct = self.codes()
        n = len(codes) - window + 1
        if n <= 0:
            return np.zeros(len(self.n_words), dtype=np.int64)
        whole = np.flatnonzero(np.arange(n) + window <= self.words[1:][self.doc[:n]])
        columns = [self.doc[:n][whole]] + [codes[j : j + n][whole] for j in range(window)]
        order, same = _equal_neighbours(columns, [len(self.n_words)] + [distinct] * window)
        order = whole[order]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(codes) + 1, dtype=np.int64)
        for j in range(window):
            covered[order[twice] + j] = 1
        return per_document(covered[:-1], self.words)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those of them equal to an earlier line of the same text), lines being split at \\n only."""
        n_docs = len(self.n_words)
        if len(self.data) == 0:
            return np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        breaks = np.flatnonzero(self.data == 10)
        cuts = np.concatenate([self.offsets[:-1], breaks + 1])  # line starts
        ends = np.concatenate([breaks, self.offsets[1:]])
        cuts.sort()
        ends.sort()
        doc = np.searchsorted(self.offsets, cuts, side="right") - 1
        doc = np.minimum(doc, n_docs - 1)
        filled = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, cuts)  # a word starts in the line
        cuts, ends, doc = cuts[filled], ends[filled], doc[filled]
        codes, distinct = word_codes(self.data, cuts, ends)
        order, same = _equal_neighbours([doc, codes], [n_docs, len(distinct)])
        again = np.zeros(len(order), dtype=bool)
        again[1:] = same
        return np.bincount(doc, minlength=n_docs), np.bincount(doc[order][again], minlength=n_docs)

