"""SentencePiece encoding and decoding through a table of distinct chunks (operator 1).

The model's pieces never hold a white-space marker after another character
(checked when the model is loaded), and its normaliser changes nothing but
spaces, so no merge can cross from a word to the marker that follows it. A text
is therefore cut into chunks: a run of markers with the word after it. Each
distinct chunk of the whole corpus is segmented once, in the bucket that owns
it, and its ids are joined back into the texts by position.

Defined results: a null text is an empty one and has no ids; a null id stays
null; repeated rows each give a row; the marker character itself counts as a
space, as the library has it, so such a text decodes to spaces; white space
other than the space is part of a word. An empty table gives an empty result.
A single text is never cut: its block holds at least that text, so a very long
text needs memory in proportion to its own length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .exchange import answer, ask, assemble, pack, unpack
from .text import buffers, hash_spans, mix

MARK = "▁"
SEPARATOR = b"\xff"
BLOCK_BYTES = 4 << 20
NAMES = ["doc_id", "n_tokens", "ids", "decoded"]
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


@functools.lru_cache(maxsize=2)
def load(model: str):
    """The model, after checking what the chunks rest on."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a white-space marker; chunks would not be exact")
    probe = " \tＡ ﬁ\r\n  é x "
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model's normaliser changes texts; chunks would not be exact")
    return sp


def chunks(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each chunk, distinct chunks without their first marker, chunk offsets of the documents).

    The first marker is the one that the library puts before a text, or the
    space before the word; a chunk without it is thus what the library is given
    to get the same ids. An empty chunk is a marker alone.
    """
    data, offsets = buffers(pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " "))
    n = len(data)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1][filled]] = True
    space = data == 32
    run_start = np.zeros(n, dtype=bool)  # a space after a word, or a document's first byte
    run_start[1:] = space[1:] & ~space[:-1]
    run_start[:1] = False
    starts = np.flatnonzero(run_start | first[:n])
    if len(starts) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    cuts = np.empty(2 * len(starts) + 1, dtype=np.int64)
    cuts[0:-1:2] = starts
    cuts[1::2] = starts + ~first[starts]
    cuts[-1] = n
    spans = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[1::2].astype(np.int64)
    used = np.bincount(codes, minlength=len(coded.dictionary)) > 0
    return (np.cumsum(used) - 1)[codes], coded.dictionary.filter(pa.array(used)), np.searchsorted(starts, offsets)


def _binary_hash(values: pa.Array) -> np.ndarray:
    _, off, data = values.buffers()
    offsets = np.frombuffer(off, np.int64, count=values.offset + len(values) + 1)[values.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return hash_spans(data, offsets[:-1], offsets[1:])


def _by_frequency(column: pa.Array, buckets: int):
    """(code of each chunk, distinct chunks, chunk offsets, bucket of each distinct chunk), the commonest chunk being code 0."""
    codes, distinct, offsets = chunks(column)
    order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    distinct = distinct.take(pa.array(order))
    return place[codes], distinct, offsets, (mix(_binary_hash(distinct)) % np.uint64(buckets)).astype(np.int32)


def _questions(batch: pa.RecordBatch, buckets: int) -> list[tuple[int, pa.RecordBatch]]:
    _, distinct, _, bucket = _by_frequency(batch.column(1), buckets)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    keys = distinct.take(pa.array(order)).to_pylist()
    cuts = [*first.tolist(), len(keys)]
    # 0xFF is in no UTF-8 text; one joined value packs tighter than a column of short ones
    return [(int(b), pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(keys[i:j])], pa.binary())], names=["chunks"])) for b, i, j in zip(found, cuts[:-1], cuts[1:], strict=True)]


def _documents(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    codes, _, offsets, bucket = _by_frequency(batch.column(1), buckets)
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)  # common chunks are 0 in all but one
    values = [pack(batch.select([0])), *(p.tobytes() for p in planes), np.diff(offsets).astype("<i4").tobytes(), bucket.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.large_binary()) for v in values], names=["ids", "p0", "p1", "p2", "p3", "counts", "bucket"])


def _serve(model: str):
    def serve(asked: list[pa.Table]) -> list[pa.RecordBatch]:
        sp = load(model)
        keys = [t["chunks"][0].as_py().split(SEPARATOR) for t in asked]
        number: dict[bytes, int] = {}
        codes = [[number.setdefault(k, len(number)) for k in ks] for ks in keys]
        del keys
        mark = [sp.piece_to_id(MARK)]
        ids = sp.encode([k.decode() for k in number], num_threads=1)  # each distinct chunk of the corpus, once
        ids = pa.array([x or mark for x in ids], pa.list_(pa.uint16() if sp.get_piece_size() <= 2**16 else pa.int32()))
        size = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        out = []
        for c in codes:
            c = np.array(c)
            values = [ids.take(pa.array(c)).flatten().to_numpy().tobytes(), size[c].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()]
            out.append(pa.RecordBatch.from_arrays([pa.array([v], pa.large_binary()) for v in values], names=["ids", "sizes"]))
        return out

    return serve


def _ids(own: pa.Table, answers: list[pa.Table], kind: str):
    """Token ids of a block and the token offsets of its documents."""
    get = lambda name: own[name][0].as_py()
    planes = np.stack([np.frombuffer(get(f"p{k}"), np.uint8) for k in range(4)], axis=1)
    codes = np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(get("counts"), "<i4"), dtype=np.int64)])
    bucket = np.frombuffer(get("bucket"), np.int32)
    sizes = [np.frombuffer(t["sizes"][0].as_py(), np.uint8) for t in answers]
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.ascontiguousarray(s.reshape(4, -1).T).view("<i4").ravel() for s in sizes)]).astype(np.int64)
    values = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(t["ids"][0].as_py(), kind) for t in answers)]).astype(np.int32)
    if len(sizes) != len(bucket):
        raise RuntimeError(f"a block has {len(sizes)} answers for {len(bucket)} chunks: its input changed between two scans")
    starts = np.empty(len(bucket) + 1, dtype=np.int64)
    length = np.empty(len(bucket), dtype=np.int64)
    order = np.argsort(bucket, kind="stable")  # the order of the answers
    starts[order], length[order] = np.cumsum(sizes) - sizes, sizes
    count = length[codes]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    take = np.repeat(starts[codes] - (ends - count), count) + np.arange(total)
    return values[take], np.concatenate([[0], ends])[offsets]


def _finish(model: str):
    def finish(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        sp = load(model)
        ids, offsets = _ids(own, answers, "<u2" if sp.get_piece_size() <= 2**16 else "<i4")
        doc_id = unpack(own["ids"][0].as_py())["doc_id"]
        decoded = [sp.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        return pa.table([doc_id, pa.array(np.diff(offsets), pa.int64()), lists, pa.array(decoded, pa.string())], names=NAMES)

    return finish


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: (doc_id, n_tokens, ids, decoded)."""
    questions, documents = ask(texts_of(docs, id_col, text_col), "text", _questions, _documents, BLOCK_BYTES)
    return assemble(documents, answer(questions, _serve(model)), _finish(model), SCHEMA)


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """SHA-256 of the decimal ids joined by commas and of the decoded text, with the ids if asked for."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    hashes = (F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return encoded.select("doc_id", "n_tokens", *(["ids"] if keep_ids else []), *hashes)
