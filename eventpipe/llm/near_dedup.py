"""MinHash near-dedup on HyperMinHash sketches (operator 3).

1. Every text becomes its set of distinct word shingles. The set's sketch keeps,
   for each of ``REGISTERS`` buckets, the minimum of the shingles under that
   bucket's hash as a leading-zero count and the ``MANTISSA`` bits after it: 16
   bits instead of 64. (A bucket has a hash of its own; splitting one hash over
   the buckets would leave most buckets of a short text empty.)
2. Equal sets (size and a 128-bit sum and xor of the shingle hashes) are one
   class, named by its smallest id. Only classes go on, so copies cost one row.
3. ``BANDS`` bands of four registers are 64-bit keys. At a similarity of 0.8 a
   pair shares no band with probability (1 - 0.8^4)^28 = 4e-7.
4. Each band key's classes are paired with the smallest of them, not with each
   other. A pair goes on if its sizes allow the similarity and its sketch
   estimate, corrected for chance collisions of registers, is not
   ``MARGIN`` below the threshold (over five standard deviations).
5. Links are confirmed on the full sets, and components are found by alternating
   large-star and small-star steps.
6. A band key whose classes still lie in several components is compared in full,
   but inside its tasks: its texts are dealt to a grid of cells of bounded size,
   each pair is looked at under the first band that it shares, pairs that pass
   size and estimate are confirmed on their full sets in place, and only links
   that join two components leave the task. So no link between components is
   lost, and no more rows come out than went in.

Defined results: a null or empty text, or one of white space, has an empty set
and is linked with nothing; fewer words than a shingle are one shingle; rows
that share an id count as one document with all their links, and each gives a
row; a row with a null id is linked with nothing (component null, kept). An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored, texts_of
from .text import buffers, documents_of, give_back, hash_words, rolling, slices, word_bounds

REGISTERS, ROWS, MANTISSA = 112, 4, 10
BANDS = REGISTERS // ROWS
MARGIN = 0.2
CELL, CELL_SHINGLES = 512, 1 << 20
_RNG = np.random.default_rng(77)
_FLIP = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_TIMES = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = 1 << 16
BLOCK_BYTES = 4 << 20


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the offsets of the texts."""
    data, offsets = buffers(column)
    starts, ends, words = word_bounds(data, offsets)
    h = hash_words(data, starts, ends, fold=True)
    doc = documents_of(words)
    count = np.diff(words)
    own = rolling(h, width, 1)
    whole = np.arange(len(own)) + width <= words[1:][doc[: len(own)]]
    hashes, docs = [own[whole]], [doc[: len(own)][whole]]
    for k in range(1, width):  # fewer words than a shingle: one shingle of them all
        short = np.flatnonzero(count == k)
        if len(short):
            cols = h[words[short][:, None] + np.arange(k)]
            hashes.append(rolling(cols.ravel(), k, 100 + k)[::k])
            docs.append(short)
    hs, ds = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(hs)
    small = np.uint16 if len(count) < 2**16 else np.int64
    order = order[np.argsort(ds[order].astype(small), kind="stable")]
    hs, ds = hs[order], ds[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    hs, ds = hs[new], ds[new]
    return hs, np.searchsorted(ds, np.arange(len(count) + 1))


def registers(hs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (documents x REGISTERS, 16 bits each); rows of empty sets are 0."""
    n = len(offsets) - 1
    least = np.zeros((REGISTERS, n), dtype=np.uint64)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    i = 0
    while i < len(filled):  # parts that fit the processor's cache
        lo = offsets[filled[i]]
        j = max(i + 1, int(np.searchsorted(offsets[filled + 1], lo + _PART, side="right")))
        part, at = hs[lo : offsets[filled[j - 1] + 1]], offsets[filled[i:j]] - lo
        for k in range(REGISTERS):
            least[k, filled[i:j]] = np.minimum.reduceat((part ^ _FLIP[k]) * _TIMES[k], at)
        i = j
    _, bits = np.frexp(least.astype(np.float64))
    bits = bits.astype(np.int64)
    over = (bits > 0) & ((least >> np.maximum(bits - 1, 0).clip(0, 63).astype(np.uint64)) == 0)
    bits = np.where(over, bits - 1, bits).clip(0, 64)  # a float may round up to the next power of two
    zeros = np.minimum(64 - bits, 63)
    lead = (least << zeros.astype(np.uint64)) >> np.uint64(63 - MANTISSA)
    return ((zeros << MANTISSA) | (lead & np.uint64(2**MANTISSA - 1)).astype(np.int64)).astype(np.uint16).T.copy()


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that a register of two disjoint sets of these sizes is equal (both minima in one cell)."""
    total = (a + b).astype(np.float64)[:, None]
    hi = 2.0 ** -np.arange(63)[None, :]
    per_level = (hi / 2 / 2**MANTISSA) * (np.exp(-total * hi / 2) - np.exp(-total * hi))
    return (a * b / total[:, 0]) * per_level.sum(axis=1)


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    c = chance(a, b)
    return (equal / REGISTERS - c) / (1 - c)


def _likely(equal, a, b, threshold: float) -> np.ndarray:
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    sized = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-6
    out = np.zeros(len(a), dtype=bool)
    near = np.flatnonzero(sized & (equal / REGISTERS >= threshold - MARGIN))
    out[near] = estimate(equal[near], a[near], b[near]) >= threshold - MARGIN
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(arr.to_pylist()), dtype=np.uint16).reshape(len(arr), REGISTERS)


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, fp_sum, fp_xor, sketch) for each row; the sketch of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                hs, offsets = shingles(part.column(1), width)
                count = np.diff(offsets)
                some = count > 0
                sums = np.zeros(len(count), dtype=np.uint64)
                xors = np.zeros(len(count), dtype=np.uint64)
                if some.any():
                    at = offsets[:-1][some]
                    sums[some] = np.add.reduceat(hs, at)
                    xors[some] = np.bitwise_xor.reduceat(hs * np.uint64(0x9E3779B97F4A7C15) ^ (hs >> np.uint64(29)), at)
                rows = registers(hs, offsets)
                sketch = pa.array([r.tobytes() if s else None for r, s in zip(rows, some, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(sums.view(np.int64)), pa.array(xors.view(np.int64)), sketch],
                    names=["doc_id", "n_shingles", "fp_sum", "fp_xor", "sketch"],
                )

    ready(texts)
    return texts.mapInArrow(run, "doc_id long, n_shingles long, fp_sum long, fp_xor long, sketch binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, doc): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _mixed(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "doc"]
                )

    return classes.select("doc", "sketch").mapInArrow(run, "key long, doc long")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_matrix(batch["sa"]) == _matrix(batch["sb"])).sum(axis=1)
                keep = _likely(equal, batch["na"].to_numpy(), batch["nb"].to_numpy(), threshold)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: classes.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                (ha, oa), (hb, ob) = shingles(part["ta"], width), shingles(part["tb"], width)
                row = np.concatenate([documents_of(oa), documents_of(ob)])
                h = np.concatenate([ha, hb])
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][twice], minlength=part.num_rows)
                union = np.diff(oa) + np.diff(ob) - both
                yield part.select(["a", "b"]).filter(pa.array((union > 0) & (100 * both >= percent * union)))
        give_back()

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star steps."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
        both = both.union(edges.select(F.col("v").alias("n"), F.col("u").alias("m"))) if large else both
        least = both.groupBy("n").agg(F.min(F.least("n", "m")).alias("least"))
        joined = both.join(least, "n")
        out = joined.where("m > n").select(F.col("m").alias("u"), F.col("least").alias("v")) if large else (
            joined.select(F.col("m").alias("u"), F.col("least").alias("v")).union(joined.select(F.col("n").alias("u"), F.col("least").alias("v")))
        )
        return out.where("u != v").distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    # u > v always: an edge points from the larger node to the smaller
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = mark(edges)
    while True:
        edges = stored(star(star(edges, True), False), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v"))).distinct()


def _mixed(rows: np.ndarray) -> np.ndarray:
    """Band keys (documents x BANDS) of register rows."""
    return (rows.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _shared_shingles(hs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Intersection sizes of all pairs of sets, as products of blocks of the incidence matrix."""
    n = len(offsets) - 1
    _, column, count = np.unique(hs, return_inverse=True, return_counts=True)
    row = documents_of(offsets)
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column)
    row, column = row[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        block = np.zeros((n, 4096), dtype=np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _residual(members: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a band key, enough of them to join all that any link joins."""
    threshold = percent / 100
    seen = members.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
    seen = seen.select("key", "doc", F.coalesce("component", "doc").alias("component"))
    seen = seen.join(classes.groupBy("doc").agg(F.max("n").alias("n")), "doc")
    open_keys = seen.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    cells = F.greatest(F.ceil(F.col("size") / CELL), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int")
    open_keys = open_keys.where("size > 2 and lo != hi").select("key", cells.alias("cells"))
    dealt = seen.join(open_keys, "key").withColumn("c", F.pmod(F.xxhash64("doc"), F.col("cells")).cast("int"))
    dealt = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select("key", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "doc", "component")
    dealt = dealt.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")

    def run(group: pa.Table) -> pa.Table:
        doc, comp, c = (group[x].to_numpy() for x in ("doc", "component", "c"))
        hs, offsets = shingles(group["text"].combine_chunks(), width)
        rows, n = registers(hs, offsets), np.diff(offsets)
        keys = _mixed(rows)
        ask = np.triu(comp[:, None] != comp[None, :], 1)
        if group["i"][0].as_py() != group["j"][0].as_py():
            ask &= c[:, None] != c[None, :]
        ask &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-6
        own = np.flatnonzero((keys == np.int64(group["key"][0].as_py()).astype(np.uint64)).all(axis=0))
        for b in range(int(own[0]) if len(own) else 0):
            ask &= keys[:, b][:, None] != keys[:, b][None, :]
        a, b = np.nonzero(ask)
        step = 1 << 16  # pairs at a time
        near = [_likely((rows[a[k : k + step]] == rows[b[k : k + step]]).sum(axis=1), n[a[k : k + step]], n[b[k : k + step]], threshold) for k in range(0, len(a), step)]
        near = np.concatenate([np.zeros(0, bool), *near])
        a, b = a[near], b[near]
        out = []
        if len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            part = np.concatenate([hs[offsets[k] : offsets[k + 1]] for k in used])
            both = _shared_shingles(part, np.concatenate([[0], np.cumsum(n[used])]))[place[: len(a)], place[len(a) :]]
            linked = 100 * both >= percent * (n[a] + n[b] - both)
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(a[linked], b[linked], strict=True):
                p, q = find(comp[x]), find(comp[y])
                if p != q:
                    root[p] = q
                    out.append((max(doc[x], doc[y]), min(doc[x], doc[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; links need ``percent`` per cent of the union."""
    threshold = percent / 100
    texts = texts_of(docs, id_col, text_col)
    every = stored(sketches(texts, width), "sketches")
    sets = every.where("doc_id is not null and n_shingles > 0")
    # stored apart from the sets, so that the join's exchange is its own and a class of many copies can be split
    one = stored(sets.groupBy("n_shingles", "fp_sum", "fp_xor").agg(F.min("doc_id").alias("doc")), "sets")
    members_of = sets.select("doc_id", "n_shingles", "fp_sum", "fp_xor").join(one, ["n_shingles", "fp_sum", "fp_xor"])
    members_of = stored(members_of.select("doc_id", "doc"), "copies")
    first = members_of.where("doc_id = doc").select("doc").distinct()
    classes = stored(
        sets.join(first, sets["doc_id"] == first["doc"], "left_semi").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sketch").distinct(),
        "classes",
    )
    keys = band_keys(classes)
    leaders = keys.groupBy("key").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader != last").select("key", "leader")
    members = stored(keys.join(leaders, "key").distinct(), "members")  # every class in a shared band, with the band's leader
    stars = members.where("doc != leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct()
    active = members.select(F.col("doc").alias("doc_id")).distinct()
    active_texts = stored(texts.join(active, "doc_id", "left_semi"), "texts")
    links = stored(confirm(likely(stars, classes, threshold), active_texts, width, percent), "links")
    labels = stored(components(links), "labels")
    more_links = stored(_residual(members.select("key", "doc"), classes, labels, active_texts, width, percent), "links")
    if not more_links.isEmpty():
        labels = stored(components(links.union(more_links)), "labels")
    # rows that share an id are one document, so its classes are linked through it
    shared = members_of.groupBy("doc_id").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo != hi")
    if not shared.isEmpty():
        united = links.union(more_links).union(members_of.join(shared.select("doc_id"), "doc_id", "left_semi").select("doc_id", "doc"))
        labels = stored(components(united), "labels")
    found = (
        members_of.join(labels, F.col("doc") == F.col("node"), "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("component", "doc")).alias("component_id"))
    )
    out = every.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the one of the smallest id, with exactly its own columns.

    Rows that share an id but not their text are documents of their own here, linked or
    not; of those that share the id and the group, the one whose text hashes lowest
    stays. Rows with an id and a text that hold no shingle are repeats only of the same id
    and text. Rows with a null id, which no group can name, all stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        verdict = stored(near_duplicates(docs, id_col, text_col, width, percent).where("doc_id is not null").select("doc_id", "kept"), "verdict")
        gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("id"))
        return docs.select(F.col(id_col).cast("long").alias("id"), row).join(gone, "id", "left_anti").select("row.*")
    key = F.when(F.col(id_col).cast("long").isNotNull(), F.monotonically_increasing_id()).alias("key")
    keyed = stored(docs.select(key, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row), "keyed")  # stored, so that a key stays with its row
    verdict = stored(near_duplicates(keyed, "key", "text", width, percent).where("doc_id is not null"), "verdict")
    rows = keyed.select(F.col("key").alias("doc_id"), "id", F.xxhash64("text").alias("hash"), F.sha2("text", 256).alias("digest"), F.xxhash64(F.to_json("row")).alias("tie"))
    empty = F.col("n_shingles") == 0
    group = [F.when(~empty, F.col("component_id")).alias("component"), F.when(empty, F.col("id")).alias("own"), F.when(empty, F.col("digest")).alias("blank")]
    first = verdict.join(rows, "doc_id").groupBy(*group).agg(F.min(F.struct("id", "hash", "tie", "doc_id")).alias("x"))
    left = keyed.join(first.select(F.col("x.doc_id").alias("key")), "key", "left_semi")
    return left.unionByName(keyed.where("key is null")).select("row.*")
