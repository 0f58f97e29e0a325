"""Quality rules as a short-circuit cascade (operator 4).

Each rule is cheap or dear, and rejects few texts or many. On a sample the
cascade measures both (seconds a text, share of texts rejected), sorts the rules
by rejection per cost, and then applies them in that order, each only to the
texts that all rules before it let through. A text is kept if no rule rejects
it, so the order changes the cost alone and never the result.

The sample (at most ``SAMPLE_ROWS`` rows) serves only that order; the rules read
every whole text.

Defined results: a null or empty text has no words, so it fails the base rule
(too few words) and is not kept; rows that repeat each give a row, and a null id
stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, texts_of
from .statistics import IS_LOWER, IS_UPPER, Texts, byte_class
from .text import slices

SAMPLE_ROWS = 2000
BLOCK_BYTES = 2 << 20
_EXCLAMATION = byte_class(b"!")


@dataclass(frozen=True)
class Rule:
    """``rejects(texts)`` says for each text of a block whether the rule rejects it."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _shouting(t: Texts) -> np.ndarray:
    upper = t.count_bytes(IS_UPPER)
    return 2 * upper > upper + t.count_bytes(IS_LOWER)


def _lines(t: Texts) -> np.ndarray:
    lines, again = t.lines()
    return 10 * again > 6 * lines


RULES = (
    Rule("symbols", lambda t: 10 * t.symbols() > t.n_words),
    Rule("exclamations", lambda t: 4 * t.count_bytes(_EXCLAMATION) > t.n_words),
    Rule("shouting", _shouting),
    Rule("short_words", lambda t: t.word_chars() < 2 * t.n_words),
    Rule("long_words", lambda t: t.word_chars() > 15 * t.n_words),
    Rule("duplicate_lines", _lines),
    Rule("few_distinct_words", lambda t: 20 * t.distinct_words() < t.n_words),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) of each rule on a sample, by rejection per cost, best first."""
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {r.name: [0, 0.0, 0] for r in rules}
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                for r in rules:
                    began = time.perf_counter()
                    rejected = int(r.rejects(Texts(part.column(0))).sum())  # each rule pays for what it needs
                    n = found[r.name]
                    n[0], n[1], n[2] = n[0] + part.num_rows, n[1] + time.perf_counter() - began, n[2] + rejected
        names, numbers = list(found), list(found.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([n[0] for n in numbers], pa.int64()), pa.array([n[1] for n in numbers]), pa.array([n[2] for n in numbers], pa.int64())],
            names=["rule", "texts", "seconds", "rejected"],
        )

    some = texts_of(docs.withColumn("__id", F.lit(0)), "__id", text_col).select("text").where("text != ''").limit(rows)
    seen = some.mapInArrow(run, "rule string, texts long, seconds double, rejected long").groupBy("rule")
    sums = {r["rule"]: r for r in seen.agg(F.sum("texts").alias("texts"), F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect()}
    out = []
    for r in rules:
        n = max(1, sums[r.name]["texts"]) if r.name in sums else 1
        out.append((r.name, sums[r.name]["seconds"] / n, sums[r.name]["rejected"] / n) if r.name in sums else (r.name, 0.0, 0.0))
    return sorted(out, key=lambda x: -x[2] / (x[1] + 1e-9))


def cascade(texts: Texts, column: pa.Array, alive: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """Which of the ``alive`` texts pass all rules; a rule sees only the texts that are still alive."""
    alive = alive.copy()
    place = np.arange(len(alive))
    for rule in rules:
        if not alive.any():
            break
        if alive[place].sum() < 0.9 * len(place):  # enough are gone for a smaller block to pay
            place = np.flatnonzero(alive)
            texts = Texts(column.take(pa.array(place)))
        alive[place[rule.rejects(texts)]] = False
    return alive


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    The base fails below ``least_words`` words, or if more than half of the words are
    in repeated three-word windows. What passes goes through the cascade.
    """
    by_name = {r.name: r for r in rules}
    order = [by_name[name] for name, _, _ in measure(docs, rules, text_col)]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                t = Texts(part.column(1))
                again, repeated = t.lines()[1], t.repeated_words()
                failed = (t.n_words < least_words) | (100 * repeated > 50 * t.n_words)
                kept = cascade(t, part.column(1), ~failed, order)
                counts = [pa.array(x, pa.int64()) for x in (t.n_words, t.word_chars(), t.symbols(), again, repeated)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(failed), pa.array(kept)], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)
