"""LM scoring by cross-entropy difference (operator 5).

Two matched n-gram models are trained here: the target on the documents that a
selection names (the query: those labelled good), the background on all
documents. Both are interpolated bigram models over the same fixed vocabulary,
the pieces of a public SentencePiece model, with the same smoothing; background
counts are scaled to the target's size, as their expectation in a random sample
of that size. A document's score is the mean over its tokens of
log p_target(token | previous) - log p_background(token | previous), in nats: the
higher, the more the text is like the target. This is Moore and Lewis'
cross-entropy difference with its sign turned.

    p(w | c) = (n(c, w) + WEIGHT * p(w)) / (n(c) + WEIGHT),   p(w) = (n(w) + 1) / (N + V)

Token counts are at most V rows for each model, so they are added up by Spark
and given to the tasks whole (V is fixed by the tokenizer). Bigrams are not
bounded so: every block of documents sends its distinct bigrams with their
counts to the bucket of the bigram, which adds them up over the corpus and
answers with one number each (see ``exchange``). All counts are over all
documents and whole texts.

Defined results: a null or empty text has no tokens and the score 0; a null id
stays null; repeated rows each give a row and count each; without any target
document the target model is its smoothing alone. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_of
from .exchange import answer, ask, assemble, buckets_of, by_bucket, concat, dealt, expect, pack, unpack
from .pieces import MARK, chunks, load


WEIGHT = 4.0
START = 1  # the context of a text's first token
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, n_tokens long, score double"


def token_ids(column: pa.Array, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and their offsets; each distinct chunk of the block is segmented once."""
    sp = load(model)
    codes, distinct, offsets = chunks(column)
    mark = [sp.piece_to_id(MARK)]
    lists = [x or mark for x in sp.encode(distinct.cast(pa.string()).to_pylist(), num_threads=1)]
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter((i for x in lists for i in x), np.int64, int(count.sum()))
    starts = np.concatenate([[0], np.cumsum(count)])
    sizes = count[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    take = np.repeat(starts[:-1][codes] - (ends - sizes), sizes) + np.arange(total)
    return values[take], np.concatenate([[0], ends])[offsets]


def bigrams(column: pa.Array, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Each token with its context as one number, context * V + token, and the offsets of the texts."""
    ids, offsets = token_ids(column, model)
    context = np.concatenate([[START], ids[:-1]]) if len(ids) else ids
    context[offsets[:-1][np.diff(offsets) > 0]] = START
    return (context * load(model).get_piece_size() + ids).astype(np.uint64), offsets


def _counted(part: pa.RecordBatch, model: str, buckets: int, target: bool) -> list[tuple[int, pa.RecordBatch]]:
    keys, count = np.unique(bigrams(part.column(1), model)[0], return_counts=True)
    wide = lambda k: pa.array(keys[k].astype(np.uint32) if len(keys) == 0 or keys[-1] < 2**32 else keys[k])
    flag = lambda k: pa.array(np.full(len(k), target))
    return dealt(keys, buckets, lambda k: pa.RecordBatch.from_arrays([wide(k).cast(pa.uint64()), pa.array(count[k], pa.int64()), flag(k)], names=["key", "n", "target"]))


def token_counts(questions: DataFrame) -> DataFrame:
    """(token, as_token, as_context, target) summed over all questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, np.ndarray] = {}
        for batch in batches:
            for body in batch["body"].to_pylist():
                t = unpack(body)
                size = int(t.schema.metadata[b"vocabulary"])
                sums_of = sums.setdefault(t["target"][0].as_py(), np.zeros((2, size), dtype=np.int64))
                key, n = t["key"].to_numpy(), t["n"].to_numpy()
                sums_of[0] += np.bincount((key % np.uint64(size)).astype(np.int64), weights=n, minlength=size).astype(np.int64)
                sums_of[1] += np.bincount((key // np.uint64(size)).astype(np.int64), weights=n, minlength=size).astype(np.int64)
        for target, s in sums.items():
            seen = np.flatnonzero(s.any(axis=0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.int32()), pa.array(s[0][seen]), pa.array(s[1][seen]), pa.array(np.full(len(seen), target))],
                names=["token", "as_token", "as_context", "target"],
            )

    rows = questions.select("body").mapInArrow(run, "token int, as_token long, as_context long, target boolean")
    return rows.groupBy("token", "target").agg(F.sum("as_token").alias("as_token"), F.sum("as_context").alias("as_context"))


def _serve(vocabulary: int, tokens: dict[bool, np.ndarray], weight: float):
    """Bigram counts of a bucket added up, and the log ratio of each bigram that the documents ask for."""
    totals = {m: tokens[m][0].sum() for m in (True, False)}
    scale = totals[True] / totals[False] if totals[True] and totals[False] else 1.0

    def log_p(key: np.ndarray, n: np.ndarray, of: bool) -> np.ndarray:
        by = 1.0 if of else scale
        word, context = (key % np.uint64(vocabulary)).astype(np.int64), (key // np.uint64(vocabulary)).astype(np.int64)
        p = (by * tokens[of][0][word] + 1) / (by * totals[of] + vocabulary)
        return np.log((by * n + weight * p) / (by * tokens[of][1][context] + weight))

    def serve(asked: list[pa.Table]) -> list[pa.RecordBatch | None]:
        target = np.array([t["target"][0].as_py() for t in asked])
        every = np.concatenate([t["key"].to_numpy() for t in asked])
        number = np.concatenate([t["n"].to_numpy() for t in asked])
        of = np.repeat(target, [len(t) for t in asked])
        keys, place = np.unique(every, return_inverse=True)
        n = {m: np.bincount(place[of == m], weights=number[of == m], minlength=len(keys)) for m in (True, False)}
        ratio = (log_p(keys, n[True], True) - log_p(keys, n[False], False)).astype(np.float32)[place]
        cuts = np.cumsum([0] + [len(t) for t in asked])
        return [None if t else pa.RecordBatch.from_arrays([pa.array(ratio[a:b])], names=["ratio"]) for t, a, b in zip(target, cuts[:-1], cuts[1:], strict=True)]

    return serve


def score(docs: DataFrame, target: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT) -> DataFrame:
    """(doc_id, n_tokens, score) for each row of ``docs``; ``target`` are the documents (same columns) of the target model."""
    vocabulary = load(model).get_piece_size()

    def told(asked: list[tuple[int, pa.RecordBatch]]) -> list[tuple[int, pa.RecordBatch]]:
        return [(b, t.replace_schema_metadata({"vocabulary": str(vocabulary)})) for b, t in asked]

    def documents(part: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack(part)], pa.large_binary()), pa.array([buckets], pa.int32())], names=["rows", "buckets"])

    texts, wanted = texts_of(docs, id_col, text_col), texts_of(target, id_col, text_col)
    buckets = buckets_of("text", texts, wanted)
    asked, held = ask(texts, "text", lambda p, b: told(_counted(p, model, b, False)), documents, BLOCK_BYTES, buckets)
    wanted, _ = ask(wanted, "text", lambda p, b: told(_counted(p, model, b, True)), documents, BLOCK_BYTES, buckets)
    questions = stored(asked.union(wanted), "bigrams")
    tokens = {m: np.zeros((2, vocabulary), dtype=np.float64) for m in (True, False)}
    for r in token_counts(questions).collect():  # at most two rows for each piece of the vocabulary
        tokens[r["target"]][:, r["token"]] = r["as_token"], r["as_context"]

    def finish(own: pa.Table, answers: list[pa.Table]) -> pa.Table:
        rows = unpack(own["rows"][0].as_py()).combine_chunks().to_batches()[0]
        every, offsets = bigrams(rows.column(1), model)
        keys, place = np.unique(every, return_inverse=True)
        expect(answers, len(keys))
        ratio = np.zeros(len(keys))
        ratio[by_bucket(keys, own["buckets"][0].as_py())[0]] = concat(answers, "ratio", pa.float32()).to_numpy()
        sums = np.concatenate([[0.0], np.cumsum(ratio[place])])
        n = np.diff(offsets)
        return pa.table([rows.column(0), pa.array(n, pa.int64()), pa.array((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1))], names=["doc_id", "n_tokens", "score"])

    return assemble(held, answer(questions, _serve(vocabulary, tokens, weight)), finish, SCHEMA)


