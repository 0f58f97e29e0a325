"""Exact substring dedup by seed and extend (operator 2).

A word is removed if it lies in a run of at least ``WINDOW`` words that a document
with a smaller id holds too. Any such run holds windows of ``WINDOW`` words, and
every window has one anchor that depends on its words alone: the leftmost
smallest hash of its ``SEED``-word shingles (winnowing). Equal windows therefore
have equal anchors at equal places, and about every fifth word is an anchor.

1. A block of documents sends the distinct anchors' fingerprints to their buckets and
   learns which of them the corpus holds more than once. Windows around the others are no repeats.
2. Neighbouring windows with one anchor are a *passage*. The block sends its distinct
   passages around repeated anchors, as words, each once with its smallest id, to the
   bucket that owns the anchor.
3. There passages meet on the seed's words and are extended both ways, a word at a
   time: passages that agree so far stay together while their next words are the same.
   A window is a seed with its extension to the left and to the right; it is a repeat
   wherever its id is not the smallest with both. Words are compared as words
   (dictionary codes), so no hash decides a match.
4. A document's adjoining repeats, taken together, are its maximal repeats.

A passage that a third of all documents share is one row for each block. An anchor
with more than ``HOT`` places, which may stand in as many contexts, is sent window by
window, dealt by the windows' own hashes; the results are the same. No pair of
documents is ever formed.

Defined results: a null or empty text has no words; a very long text is one block of
its own; rows that share an id are not compared with each other, but each is compared
with smaller ids; a row with a null id is neither a source of repeats nor loses words;
repeated rows each give a row. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import suffix_dedup
from .common import texts_of
from .exchange import DOCUMENTS, answer, ask, assemble, block_name, block_rows, buckets_of, by_bucket, concat, dealt, expect, pack, unpack
from .suffix_dedup import buffers_of, known_repeats, least_by, spans
from .text import buffers, documents_of, give_back, hash_spans, per_document, rolling, word_bounds, word_codes

WINDOW, SEED = 13, 5
BLOCK_BYTES = 4 << 20
PART_ROWS = 1 << 17  # passages that are extended together
SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept_text string"


class Passages(NamedTuple):
    """Runs of windows with one anchor: the first window's first word, the number of windows, the anchor's word and hash."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


class Words(NamedTuple):
    """A block's words: where they stand in a buffer of bytes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # of the documents, in words


def words_of(batch: pa.RecordBatch) -> Words:
    """The words as they stand in the texts; only who meets is found from these, by their hashes."""
    data, offsets = buffers(batch.column(1))
    return Words(data, *word_bounds(data, offsets))


def joined(w: Words) -> Words:
    """The words joined by single spaces, so that equal runs of words are equal bytes."""
    data, starts, words = w.data, w.starts, w.offsets
    sizes = w.ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 32, dtype=np.uint8)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(begin, sizes) + step] = data.take(np.repeat(starts, sizes) + step)
    return Words(out, begin, begin + sizes, words)


def passages(w: Words, named: np.ndarray, window: int, seed: int) -> Passages:
    """The passages of a block's named documents, in text order."""
    h = hash_spans(w.data, w.starts, w.ends)
    n = max(0, len(h) - window + 1)
    doc = documents_of(w.offsets)
    at = np.flatnonzero((np.arange(n) + window <= w.offsets[1:][doc[:n]]) & named[doc[:n]])
    shingle = rolling(h, seed, 11)
    best, anchor = shingle[at], at.copy()
    for j in range(1, window - seed + 1):
        other = shingle[at + j]
        less = other < best
        best, anchor = np.where(less, other, best), np.where(less, at + j, anchor)
    run = np.ones(len(at), dtype=bool)
    run[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(run)
    return Passages(at[first], np.diff(np.append(first, len(at))), anchor[first], best[first])


class Sent(NamedTuple):
    """What a block asks about: its distinct passages in the order sent, and where each stands."""

    texts: pa.Array
    place: np.ndarray  # the seed's first word, in the passage
    route: np.ndarray
    least: np.ndarray  # the smallest id of the block that holds the passage
    start: np.ndarray  # of every place: the first window's first word
    windows: np.ndarray
    passage: np.ndarray  # which passage, in the order sent
    again: np.ndarray  # whether a smaller id of the block holds it


def sent(batch: pa.RecordBatch, w: Words, found: Passages, code_of: np.ndarray, buckets: int, window: int) -> Sent:
    """``code_of``: for each passage 0 (its anchor is nowhere else), 1, or 2 (a hot anchor: sent window by window)."""
    whole, hot = code_of == 1, code_of == 2
    count = found.windows[hot]
    single = np.repeat(found.start[hot] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    start = np.concatenate([found.start[whole], single])
    windows = np.concatenate([found.windows[whole], np.ones(len(single), np.int64)])
    place = np.concatenate([found.anchor[whole], np.repeat(found.anchor[hot], count)]) - start
    route = found.hash[whole]
    if len(single):
        route = np.concatenate([route, rolling(hash_spans(w.data, w.starts, w.ends), window, 7)[single]])
    low, high = w.starts[start], w.ends[start + windows + window - 2] if len(start) else w.ends[:0]
    coded = spans(w.data, low, high - low).dictionary_encode()
    # equal words can have their anchor at two places, if passages end at documents' ends
    codes = coded.indices.to_numpy().astype(np.int64) * (window + 1) + place
    kept, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    ids = batch.column(0).fill_null(0).to_numpy()[documents_of(w.offsets)[start]]
    least = least_by(codes, ids, len(kept))
    order, _, _ = by_bucket(route[first], buckets)
    put = np.empty(len(kept), dtype=np.int64)
    put[order] = np.arange(len(kept))
    texts = coded.dictionary.take(pa.array(kept[order] // (window + 1)))
    return Sent(texts, kept[order] % (window + 1), route[first][order], least[order], start, windows, put[codes], ids > least[codes])


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Small codes for pairs of codes."""
    if not len(left):
        return left
    return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]


def repeated_windows(texts: pa.Array, place: np.ndarray, ids: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For every window of every passage, in order: whether a passage with a smaller id holds it. Seeds meet and are extended word by word."""
    data, offsets = buffers_of(texts)
    starts, ends, words = word_bounds(data, offsets)
    code = word_codes(data, starts, ends)[0] + 1  # 0: no word, the passage has ended
    size, rows = np.diff(words), np.arange(len(texts))

    def word(at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < size)
        return np.where(inside, code[np.where(inside, words[:-1] + at, 0)] if len(code) else 0, 0)

    agree = np.zeros(len(rows), dtype=np.int64)
    for j in range(seed):
        agree = _paired(agree, word(place + j))
    span = window - seed
    right, left = [agree], [agree]
    for j in range(span):
        right.append(_paired(right[-1], word(place + seed + j)))
        left.append(_paired(left[-1], word(place - 1 - j)))
    count = size - window + 1
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=bool)
    for p in range(span + 1):  # windows with p words before the seed
        has = rows[(place - p >= 0) & (place - p < count)]
        if len(has):
            same = _paired(left[p][has], right[span - p][has])
            least = least_by(same, ids[has], int(same.max()) + 1)
            out[first[has] + place[has] - p] = ids[has] > least[same]
    return out


def _serve(window: int, seed: int):
    """Step 3 for one bucket, some passages at a time; those of an anchor stay together."""

    def run(asked: list[pa.Table]) -> list[pa.RecordBatch]:
        table = pa.concat_tables(asked)
        coded = pa.concat_arrays([c.cast(pa.large_binary()) for c in table["text"].chunks] or [pa.array([], pa.large_binary())]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64) * (window + 1) + table["place"].to_numpy().astype(np.int64)
        kept, first, codes = np.unique(codes, return_index=True, return_inverse=True)
        ids, windows, n = table["doc"].to_numpy(), table["windows"].to_numpy().astype(np.int64), len(kept)
        least, count, route = least_by(codes, ids, n), windows[first], table["route"].to_numpy()[first]
        at = np.cumsum(count) - count
        hit = np.zeros(int(count.sum()), dtype=bool)  # of the distinct passages' windows, for the smallest id
        order, a = np.argsort(route, kind="stable"), 0
        while a < n:
            b = min(n, a + PART_ROWS)
            b += int(np.searchsorted(route[order[b:]], route[order[b - 1]], side="right"))
            part = order[a:b]
            found = repeated_windows(coded.dictionary.take(pa.array(kept[part] // (window + 1))), kept[part] % (window + 1), least[part], window, seed)
            own = count[part]
            hit[np.repeat(at[part] - (np.cumsum(own) - own), own) + np.arange(len(found))] = found
            a = b
        own = windows
        every = hit[np.repeat(at[codes] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))] | np.repeat(ids > least[codes], own)
        bounds = np.concatenate([[0], np.cumsum(own)])[np.cumsum([0, *map(len, asked)])]
        out = [pa.RecordBatch.from_arrays([pa.array(every[a:b])], names=["match"]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        del table, coded
        give_back()
        return out

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text) for each row.

    ``removed`` are the repeats as word ranges (end exclusive); ``kept_text`` the other words, joined by one space.
    """
    seed = min(SEED, window)

    def found_in(batch: pa.RecordBatch) -> tuple[Words, Passages]:
        w = words_of(batch)
        return w, passages(w, batch.column(0).is_valid().to_numpy(zero_copy_only=False), window, seed)

    def anchors(batch: pa.RecordBatch, buckets: int) -> list[tuple[int, pa.RecordBatch]]:
        hashes, places = np.unique(found_in(batch)[1].hash, return_counts=True)
        row = lambda k: pa.RecordBatch.from_arrays([pa.array(hashes[k].astype(np.uint32)), pa.array(places[k].astype(np.uint32))], names=["print", "places"])
        return dealt(hashes, buckets, row)

    def packed(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack(batch)], pa.large_binary())], names=["rows"])

    def asked_by(own: pa.Table, answers: list[pa.Table]) -> tuple[pa.RecordBatch, Sent]:
        batch = unpack(own["rows"][0].as_py()).combine_chunks().to_batches()[0]
        w, found = found_in(batch)
        hashes, inverse = np.unique(found.hash, return_inverse=True)
        expect(answers, len(hashes))
        code = np.zeros(len(hashes), dtype=np.uint8)
        code[by_bucket(hashes, buckets)[0]] = concat(answers, "code", pa.uint8()).to_numpy()
        return batch, sent(batch, joined(w), found, code[inverse], buckets, window)

    def ask_passages(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        batch, s = asked_by(own, answers)
        of = np.zeros(len(s.texts), dtype=np.int64)
        of[s.passage] = s.windows
        _, at, bounds = by_bucket(s.route, buckets)  # already in this order
        columns = [pa.array(s.least), s.texts, pa.array(s.place.astype(np.uint16)), pa.array(of.astype(np.uint16)), pa.array((s.route >> np.uint64(32)).astype(np.uint32))]
        keys = pa.RecordBatch.from_arrays(columns, names=["doc", "text", "place", "windows", "route"])
        out = [(block_name(batch), int(b), pack(keys.slice(int(bounds[i]), int(bounds[i + 1] - bounds[i])))) for i, b in enumerate(at)]
        give_back()
        return block_rows(out)

    def hold_documents(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        batch, s = asked_by(own, answers)
        one = lambda x: pa.array([x], pa.list_(pa.array(x[:0]).type))
        of = np.zeros(len(s.texts), dtype=np.int64)
        of[s.passage] = s.windows
        columns = [s.start.astype(np.uint32), s.windows.astype(np.uint16), s.passage.astype(np.uint32), s.again, of.astype(np.uint16)]
        body = pa.RecordBatch.from_arrays([own["rows"].chunk(0).cast(pa.large_binary()), *map(one, columns)], names=["rows", "start", "windows", "passage", "again", "of"])
        give_back()
        return block_rows([(block_name(batch), DOCUMENTS, pack(body))])

    def finish(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        rows = unpack(own["rows"][0].as_py()).combine_chunks().to_batches()[0]
        start, windows, passage, again, of = (own[c].combine_chunks().values.to_numpy(zero_copy_only=False).astype(kind) for c, kind in (("start", np.int64), ("windows", np.int64), ("passage", np.int64), ("again", bool), ("of", np.int64)))
        expect(answers, int(of.sum()))
        hit = concat(answers, "match", pa.bool_()).to_numpy(zero_copy_only=False)
        first = np.cumsum(of) - of
        step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (np.repeat(start, windows) + step)[np.repeat(again, windows) | hit[np.repeat(first[passage], windows) + step]]
        data, text_offsets = buffers(rows.column(1))
        starts, _, words = word_bounds(data, text_offsets)
        cover = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[words] = True
        begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone))
        stop = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]) if len(gone) else gone)) + 1
        doc = documents_of(words)[begin]
        lists = pa.StructArray.from_arrays([pa.array((begin - words[doc]).astype(np.int32)), pa.array((stop - words[doc]).astype(np.int32))], names=["start", "end"])
        kept = []
        for k, text in enumerate(rows.column(1).to_pylist()):
            own_words = gone[words[k] : words[k + 1]]
            every = text.encode().split()
            kept.append(b" ".join([w for w, g in zip(every, own_words.tolist(), strict=True) if not g] if own_words.any() else every).decode())
        return pa.table(
            [
                rows.column(0), pa.array(np.diff(words), pa.int64()), pa.array(per_document(gone, words), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(words))), pa.int32()), lists), pa.array(kept, pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
        )

    docs = texts_of(docs, id_col, text_col)
    buckets = buckets_of("text", docs)
    questions, held = ask(docs, "text", anchors, packed, BLOCK_BYTES, buckets)
    known = answer(questions, known_repeats)
    asked, rows = (assemble(held, known, f, "block string, bucket int, body binary") for f in (ask_passages, hold_documents))
    return assemble(rows, answer(asked, _serve(window, seed)), finish, SCHEMA)
