"""Exact byte-level dedup with suffix arrays (operator 12).

A byte is removed if it lies in a string of ``WINDOW`` bytes that also starts in a
document with a smaller id. A suffix array of the whole corpus would be sorted in
one place; here the corpus is cut so that equal strings always meet in one shard:

1. Every window has one anchor that depends on its bytes alone, the leftmost
   smallest hash of its ``SEED``-byte strings. A block of documents sends the
   distinct anchors' fingerprints to their buckets and learns which of them the
   corpus holds more than once. No window around another anchor can repeat.
2. Neighbouring windows with the same anchor are one *passage*. A block sends its
   distinct passages around repeated anchors, each once with its smallest id, to
   the shard that owns the anchor.
3. A shard joins its passages with separators, sorts all their suffixes by induced
   sorting and computes permuted common prefixes (``suffix_array``). Suffixes with a
   common prefix of ``WINDOW`` bytes are one string; it repeats wherever its id is
   not the smallest. Only these decisions remove bytes; hashes decide no match.
4. Blocks take the answers in by position and cut their documents.

A passage that a third of all documents share is one row for each block. An anchor
with more than ``HOT`` places, which may stand in as many different contexts, is sent
as single windows, spread by the windows' own hashes, so that no shard gathers
them; the results are the same. A shard is sorted in parts of whole anchors, of
about ``PART_BYTES``, so memory does not follow a bucket's size.

Defined results: a null or empty text has no bytes; a text shorter than the window
loses none; a very long text is one block of its own and costs its own length;
rows that share an id are not compared with each other, but each is compared with
smaller ids; a row with a null id is neither a source of repeats nor loses bytes;
repeated rows each give a row. An empty table gives an empty result. Kept bytes
are binary, as a cut may fall inside a character.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of
from .exchange import BLOCK_BYTES, DOCUMENTS, answer, ask, assemble, block_name, block_rows, buckets_of, by_bucket, concat, dealt, expect, pack, unpack
from .suffix_array import permuted_prefixes, suffix_array
from .text import buffers, documents_of, give_back, mix, per_document

WINDOW, SEED = 50, 24
HOT = 1 << 16  # places of an anchor, in all documents, from which its windows are spread one by one
PART_BYTES = 1 << 20  # of passages in one suffix array
PIECE = 1 << 16  # windows whose anchors are found at a time
_PLACE = np.uint64((1 << 21) - 1)  # a place in a piece; the rest of a key is hash
SCHEMA = "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"


class Passages(NamedTuple):
    """Runs of windows with one anchor: first window, number of windows, hash of the anchor."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray


_ODD = np.random.default_rng(20240312).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def string_hashes(data: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the ``size`` bytes at every place (or at some), from eight bytes at a time."""
    step = min(8, size)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
    words = np.ascontiguousarray(words) if at is None else words
    at = slice(0, len(data) - size + 1) if at is None else at
    h = None
    for k, shift in enumerate([*range(0, size - step, step), size - step]):
        word = words[shift:][at]
        if step < 8:
            word = word & np.uint64((1 << 8 * step) - 1)
        word = word * _ODD[k % 64]
        word ^= word >> np.uint64(29 + k % 8)
        h = word if h is None else h * _ODD[-1] + word
    return mix(h)


def passages(data: np.ndarray, offsets: np.ndarray, named: np.ndarray, window: int, seed: int) -> Passages:
    """The passages of a block's named documents, in text order."""
    n = len(data) - window + 1
    if n <= 0:
        return Passages(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    long_enough = named & (np.diff(offsets) >= window)
    edge[offsets[:-1][long_enough]] += 1
    edge[offsets[1:][long_enough] - window + 1] -= 1
    whole = np.cumsum(edge[:n], dtype=np.int8) > 0
    starts, counts, hashes = [], [], []
    for low in range(0, n, PIECE):
        ok = whole[low : low + PIECE]
        if not ok.any():
            continue
        h = string_hashes(data[low : low + len(ok) + window - 1], seed)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, width = window - seed + 1, 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        anchor = (key & _PLACE).astype(np.int64)
        begin = ok.copy()
        begin[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
        stop = ok.copy()
        stop[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1])
        first, last = np.flatnonzero(begin), np.flatnonzero(stop)
        starts.append(first + low)
        counts.append(last - first + 1)
        hashes.append(h[anchor[first]])
    empty = [np.zeros(0, np.int64)]
    return Passages(np.concatenate(starts or empty), np.concatenate(counts or empty), np.concatenate(hashes or [np.zeros(0, np.uint64)]))


def spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of (overlapping) spans, as a binary column."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(bounds[-1], dtype=np.int64) + np.repeat(starts - bounds[:-1], sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.take(take))])


def least_by(codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The least value of each code; every code occurs."""
    order = np.argsort(codes, kind="stable")
    return np.minimum.reduceat(values[order], np.searchsorted(codes[order], np.arange(n))) if n else values[:0]


class Sent(NamedTuple):
    """What a block asks about: its distinct passages in the order sent, and where each stands."""

    texts: pa.Array
    route: np.ndarray
    least: np.ndarray  # the smallest id that holds the passage, in the block
    start: np.ndarray  # of every place
    windows: np.ndarray
    passage: np.ndarray  # which passage, in the order sent
    again: np.ndarray  # whether a smaller id of the block holds it


def sent(batch: pa.RecordBatch, code_of: np.ndarray, found: Passages, buckets: int, window: int) -> Sent:
    """``code_of``: for each passage 0 (its anchor is nowhere else), 1 or 2 (a hot anchor, sent window by window)."""
    data, offsets = buffers(batch.column(1))
    whole, hot = code_of == 1, code_of == 2
    count = found.windows[hot]
    single = np.repeat(found.start[hot] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    start = np.concatenate([found.start[whole], single])
    windows = np.concatenate([found.windows[whole], np.ones(len(single), np.int64)])
    route = np.concatenate([found.anchor[whole], string_hashes(data, window, single) if len(single) else found.anchor[:0]])
    ids = batch.column(0).fill_null(0).to_numpy()[np.searchsorted(offsets, start, side="right") - 1]
    coded = spans(data, start, windows + window - 1).dictionary_encode()
    codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    least = least_by(codes, ids, n)
    first = least_by(codes, np.arange(len(codes)), n)
    order, _, _ = by_bucket(route[first], buckets)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    return Sent(coded.dictionary.take(pa.array(order)), route[first][order], least[order], start, windows, place[codes], ids > least[codes])


def repeated_windows(texts: pa.Array, ids: np.ndarray, window: int) -> np.ndarray:
    """For every window of every passage, in order: whether a passage with a smaller id holds it. The suffix array decides."""
    data, offsets = buffers_of(texts)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - window + 1, 0)
    text = np.zeros(len(data) + len(sizes), dtype=np.uint8)
    begins = offsets[:-1] + np.arange(len(sizes))
    text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data + np.uint8(1)  # 0 separates; UTF-8 has no byte above 0xF4
    array = suffix_array(text)
    joined = permuted_prefixes(text, array).take(array) >= window
    owner = np.full(len(text), -1, dtype=np.int64)
    place = np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    owner[place] = np.repeat(np.arange(len(sizes)), count)
    mine = owner.take(array)
    run = np.cumsum(~joined)  # strings of ``window`` symbols, in order; a run is all windows or none
    valid = mine >= 0
    array, mine, run = array[valid], mine[valid], run[valid]
    out = np.zeros(len(text), dtype=bool)
    if len(run):
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        least = np.minimum.reduceat(ids[mine], first)
        out[array] = ids[mine] > np.repeat(least, np.diff(np.append(first, len(run))))
    return out[place]


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary column without nulls."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def known_repeats(asked: list[pa.Table]) -> list[pa.RecordBatch]:
    """Step 1: 0, 1 or 2 for each fingerprint of an anchor."""
    table = pa.concat_tables(asked)
    prints, inverse = np.unique(table["print"].to_numpy(), return_inverse=True)
    places = np.bincount(inverse, weights=table["places"].to_numpy(), minlength=len(prints))
    code = ((places > 1).astype(np.uint8) + (places > HOT))[inverse]
    cuts = np.cumsum([0, *map(len, asked)])
    return [pa.RecordBatch.from_arrays([pa.array(code[a:b], pa.uint8())], names=["code"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _serve(window: int):
    """Step 3 for one bucket: its passages, part by part."""

    def run(asked: list[pa.Table]) -> list[pa.RecordBatch]:
        table = pa.concat_tables(asked)
        coded = pa.concat_arrays([c.cast(pa.large_binary()) for c in table["text"].chunks] or [pa.array([], pa.large_binary())]).dictionary_encode()
        codes, texts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        ids, n = table["doc"].to_numpy(), len(coded.dictionary)
        least = least_by(codes, ids, n)
        route = table["route"].to_numpy()[least_by(codes, np.arange(len(codes)), n)] if n else np.zeros(0, np.uint32)
        order = np.argsort(route, kind="stable")
        sizes = np.diff(buffers_of(texts)[1])
        count = sizes - window + 1
        first = np.cumsum(count) - count
        hit = np.zeros(int(count.sum()), dtype=bool)  # of the distinct passages' windows, for the smallest id
        end, a = np.cumsum(sizes[order]), 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PART_BYTES)))
            b += int(np.searchsorted(route[order[b:]], route[order[b - 1]], side="right"))  # an anchor's passages stay together
            part = order[a:b]
            found = repeated_windows(texts.take(pa.array(part)), least[part], window)
            own = count[part]
            hit[np.repeat(first[part] - (np.cumsum(own) - own), own) + np.arange(len(found))] = found
            a = b
        own = count[codes]
        every = hit[np.repeat(first[codes] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))] | np.repeat(ids > least[codes], own)
        bounds = np.concatenate([[0], np.cumsum(own)])[np.cumsum([0, *map(len, asked)])]
        out = [pa.RecordBatch.from_arrays([pa.array(every[a:b])], names=["match"]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        del table, coded, texts
        give_back()
        return out

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) for each row.

    ``removed`` are the maximal removed runs as byte ranges (end exclusive); ``kept`` the other bytes.
    """
    seed = min(SEED, max(1, window // 2))

    def found_in(batch: pa.RecordBatch) -> Passages:
        data, offsets = buffers(batch.column(1))
        return passages(data, offsets, batch.column(0).is_valid().to_numpy(zero_copy_only=False), window, seed)

    def anchors(batch: pa.RecordBatch, buckets: int) -> list[tuple[int, pa.RecordBatch]]:
        hashes, places = np.unique(found_in(batch).anchor, return_counts=True)
        return dealt(
            hashes, buckets, lambda k: pa.RecordBatch.from_arrays([pa.array(hashes[k].astype(np.uint32)), pa.array(places[k].astype(np.uint32))], names=["print", "places"])
        )

    def packed(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack(batch)], pa.large_binary())], names=["rows"])

    def asked_by(own: pa.Table, answers: list[pa.Table]) -> tuple[pa.RecordBatch, Sent]:
        batch = unpack(own["rows"][0].as_py()).combine_chunks().to_batches()[0]
        found = found_in(batch)
        hashes, inverse = np.unique(found.anchor, return_inverse=True)
        expect(answers, len(hashes))
        code = np.zeros(len(hashes), dtype=np.uint8)
        code[by_bucket(hashes, buckets)[0]] = concat(answers, "code", pa.uint8()).to_numpy()
        return batch, sent(batch, code[inverse], found, buckets, window)

    def ask_passages(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        batch, s = asked_by(own, answers)
        _, at, bounds = by_bucket(s.route, buckets)  # already in this order
        keys = pa.RecordBatch.from_arrays([pa.array(s.least), s.texts, pa.array((s.route >> np.uint64(32)).astype(np.uint32))], names=["doc", "text", "route"])
        out = [(block_name(batch), int(b), pack(keys.slice(int(bounds[i]), int(bounds[i + 1] - bounds[i])))) for i, b in enumerate(at)]
        give_back()
        return block_rows(out)

    def hold_documents(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        batch, s = asked_by(own, answers)
        of = np.empty(len(s.texts), dtype=np.int64)
        of[s.passage] = s.windows
        one = lambda x: pa.array([x], pa.list_(pa.array(x[:0]).type))
        body = pa.RecordBatch.from_arrays(
            [own["rows"].chunk(0).cast(pa.large_binary()), one(s.start.astype(np.uint32)), one(s.windows.astype(np.uint16)), one(s.passage.astype(np.uint32)), one(s.again), one(of.astype(np.uint16))],
            names=["rows", "start", "windows", "passage", "again", "of"],
        )
        give_back()
        return block_rows([(block_name(batch), DOCUMENTS, pack(body))])

    def finish(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        batch = unpack(own["rows"][0].as_py()).combine_chunks().to_batches()[0]
        start, windows, passage, again, of = (own[c].combine_chunks().values.to_numpy(zero_copy_only=False).astype(kind) for c, kind in (("start", np.int64), ("windows", np.int64), ("passage", np.int64), ("again", bool), ("of", np.int64)))
        expect(answers, int(of.sum()))
        hit = concat(answers, "match", pa.bool_()).to_numpy(zero_copy_only=False)
        first = np.cumsum(of) - of
        step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = np.repeat(again, windows) | hit[np.repeat(first[passage], windows) + step]
        at = (np.repeat(start, windows) + step)[gone]
        data, offsets = buffers(batch.column(1))
        cover = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        removed = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begin = np.flatnonzero(removed & (edge[:-1] | ~np.concatenate([[False], removed[:-1]]))) if len(data) else np.zeros(0, np.int64)
        stop = np.flatnonzero(removed & (edge[1:] | ~np.concatenate([removed[1:], [False]]))) + 1 if len(data) else begin
        doc = np.searchsorted(offsets, begin, side="right") - 1
        lists = pa.StructArray.from_arrays([pa.array(begin - offsets[doc], pa.int64()), pa.array(stop - offsets[doc], pa.int64())], names=["start", "end"])
        n_removed = per_document(removed, offsets)
        kept = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets - np.concatenate([[0], np.cumsum(n_removed)])), pa.py_buffer(data[~removed])])
        out = pa.table(
            [
                batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(offsets))), pa.int32()), lists), kept.cast(pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "removed", "kept"],
        )
        return out

    docs = texts_of(docs, id_col, text_col)
    buckets = buckets_of("text", docs)
    questions, held = ask(docs, "text", anchors, packed, BLOCK_BYTES, buckets)
    known = answer(questions, known_repeats)
    asked, rows = (assemble(held, known, f, "block string, bucket int, body binary") for f in (ask_passages, hold_documents))
    return assemble(rows, answer(asked, _serve(window)), finish, SCHEMA)
