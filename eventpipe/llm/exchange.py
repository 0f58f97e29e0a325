"""Ask-and-answer between blocks of documents and buckets of keys, as two shuffles of packed rows.

Many operators look up one value for each distinct key (word, n-gram) of a
corpus. A row per (document, key) is several times the corpus itself. Here a
block of documents sends its *distinct* keys once to the bucket of each key, as
one packed row per (block, bucket); a bucket sees every key it owns from all
blocks together, works out a value once, and answers in the same order. The
block then joins the values back by position. Rows per key are at most one per
block, so a word that fills a third of the corpus is not a hot key. The number of
buckets follows the measured bytes of text, so a task that holds a whole bucket
holds the keys of about ``BUCKET_BYTES`` of text at any size of the corpus.

The frame is scanned twice by the same deterministic function (once for what is
sent, once for the packed documents), so nothing has to be stored. A block is
named by the hash of its rows: were the two scans ever to cut blocks differently,
names would not meet and the job would stop, not mix them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ready
from .text import blocks, mix

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # of text for each bucket
ROWS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("body", pa.binary())])
SPARK_ROWS = "block string, bucket int, body binary"
DOCUMENTS = -1  # the bucket of a block's own documents


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    """Arrow IPC, compressed by zstd."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by (bucket, hash), the buckets that occur, and their bounds in that order."""
    bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    found, first = np.unique(bucket[order], return_index=True)
    return order, found, np.append(first, len(order))


def _rows(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ROWS, strict=True)], schema=ROWS)


def block_rows(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    """Rows (block, bucket, body) for a second round of questions, also when there are none."""
    return pa.Table.from_batches([_rows(rows)] if rows else [], ROWS)


def block_name(part: pa.RecordBatch) -> str:
    """A block's name: the hash of all its columns, so that equal rows give equal names in every scan."""
    h = xxhash.xxh3_128()
    for column in part.columns:
        for b in pa.concat_arrays([column]).buffers():
            if b is not None:
                h.update(b)
    return h.hexdigest()


def buckets_of(text: str, *frames: DataFrame) -> int:
    """One bucket for each ``BUCKET_BYTES`` of text in all the frames, and not fewer than shuffle partitions."""
    spark = [ready(f) for f in frames][0]
    size = sum(f.agg(F.sum(F.octet_length(text).cast("long")).alias("bytes")).first()["bytes"] or 0 for f in frames)
    return max(partitions(spark), -(-size // BUCKET_BYTES))


def ask(
    docs: DataFrame,
    text: str,
    questions: Callable[[pa.RecordBatch, int], list[tuple[int, pa.RecordBatch]]],
    documents: Callable[[pa.RecordBatch, int], pa.RecordBatch],
    block_bytes: int = BLOCK_BYTES,
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(questions, documents), both as rows (block, bucket, body).

    ``questions(block, buckets)`` gives (bucket, keys) once for each bucket asked;
    ``documents(block, buckets)`` what the block needs to take in the answers.
    Frames that ask the same buckets need the same ``buckets``.
    """
    ready(docs)
    buckets = buckets or buckets_of(text, docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text, block_bytes):
            asked = questions(part, buckets)
            if asked:
                name = block_name(part)
                yield _rows([(name, k, pack(keys)) for k, keys in asked])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text, block_bytes):
            yield _rows([(block_name(part), DOCUMENTS, pack(documents(part, buckets)))])

    return docs.mapInArrow(send, SPARK_ROWS), docs.mapInArrow(hold, SPARK_ROWS)


def answer(questions: DataFrame, serve: Callable[[list[pa.Table]], list[pa.RecordBatch | None]]) -> DataFrame:
    """Answers as rows (block, bucket, body); ``serve`` gets all questions of one bucket and answers in their order (or not)."""

    def run(group: pa.Table) -> pa.Table:
        answers = [None if a is None else pack(a) for a in serve([unpack(b) for b in group["body"].to_pylist()])]
        out = pa.table([group["block"].cast(pa.string()), group["bucket"].cast(pa.int32()), pa.array(answers, pa.binary())], schema=ROWS)
        pa.default_memory_pool().release_unused()
        return out.filter(out["body"].is_valid())

    return questions.groupBy("bucket").applyInArrow(run, SPARK_ROWS)


def assemble(documents: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, list[pa.Table]], pa.Table], schema: str) -> DataFrame:
    """``finish(documents, answers by ascending bucket)`` for each block."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"].to_numpy()
        own = np.flatnonzero(bucket == DOCUMENTS)
        if not len(own):
            raise RuntimeError("answers for a block that is not there: the input changed between two scans")
        at = {int(b): i for i, b in enumerate(bucket) if b != DOCUMENTS}  # equal blocks get equal answers
        out = finish(unpack(group["body"][int(own[0])].as_py()), [unpack(group["body"][at[b]].as_py()) for b in sorted(at)])
        pa.default_memory_pool().release_unused()
        return pa.concat_tables([out] * len(own)) if len(own) > 1 else out

    return documents.unionByName(answers).groupBy("block").applyInArrow(run, schema)


def expect(answers: list[pa.Table], rows: int) -> None:
    """Every key that a block asked for has an answer, or the job stops."""
    got = sum(len(t) for t in answers)
    if got != rows:
        raise RuntimeError(f"a block has {got} answers for {rows} keys: its input changed between two scans")


def concat(tables: list[pa.Table], column: str, kind: pa.DataType) -> pa.Array:
    """One column of all answers, in order."""
    chunks = [c for t in tables for c in t[column].chunks]
    return pa.concat_arrays(chunks) if chunks else pa.array([], kind)


def dealt(hashes: np.ndarray, buckets: int, keys: Callable[[np.ndarray], pa.RecordBatch]) -> list[tuple[int, pa.RecordBatch]]:
    """(bucket, keys) of all keys, in the order of ``by_bucket``."""
    order, found, bounds = by_bucket(hashes, buckets)
    return [(int(b), keys(order[bounds[i] : bounds[i + 1]])) for i, b in enumerate(found)]
