"""Token-id output as fixed-width packed bits (operator 9).

A file is a Parquet folder with one row for each block of documents, so Spark's
readers and committers handle it on any store: a task that is lost or run twice
leaves no second copy. A block's ``body`` stands for itself:

    bytes  0-3   "TKB1"
    byte   4     bits for an id, the fewest that hold the vocabulary
    bytes  8-15  documents in the block, n       (little-endian unsigned 64)
    bytes 16-23  ids in the block, m
    then   n     document ids                    (little-endian signed 64)
    then   n     1 where the document id is null, padded with zeros to a multiple of 8
    then   n + 1 offsets of the documents in ids (little-endian unsigned 64)
    then         m ids of that many bits each, lowest bit first, without gaps

``numpy`` unpacks a whole block or, from the offsets, the ids of one document
alone. Blocks are in ascending order of the document id over the whole file:
``part`` numbers the ranges of ids, ``block`` the blocks in a range, and
``first_id`` and ``last_id`` let a reader skip all other blocks by pushed filters.

Texts are encoded word by word: the tokenizer drops white space and never merges
across it, so a distinct word is encoded once for each block, and a word that comes
again and again once for each worker. Blocks, what a worker remembers and row groups
are bounded, so memory does not grow with the table (a longer text is a block alone).

Defined results: a null or empty text has only the end id; null document ids
come first; rows of one id are in the order of their text's hash and text, and
repeated rows are repeated documents. An empty table gives an empty file.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, partitions, ready, texts_of
from .text import blocks, buffers, word_bounds, word_codes

MAGIC = b"TKB1"
BLOCK_BYTES = 2 << 20
MOST_CACHED = 150_000  # in each of two generations
#: By default the writer looks at its size after 100 rows at the earliest, and a row is a block; readers load a row group at once.
GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
BLOCK_SCHEMA = "part int, block long, first_id long, last_id long, n_docs long, n_tokens long, body binary"
#: ASCII signs that make one token with the signs beside them; not ', which may begin one with letters, nor < | > of special tokens.
_TRAILING = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_CLOSES, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_CLOSES[list(_TRAILING)] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MOST_SIGNS = 8  # cut off a word
_LATIN = "\u024f"  # up to here lower case is one rule for all libraries
#: Fixed rule of byte-level tokenizers: a printable byte is its own symbol, the n-th other one is code point 256 + n.
_BYTE_SYMBOLS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_PROBES = [w.encode() for w in ("The", "end.", "Straße,", "don't", "it's!?", "rest***", "naïf.&&&", "a)-b])", "-", "a1b2", "ÉTÉ...", "x", "co-op;", "<|endoftext|>", "é", "naïve!!")]


# --- bits -------------------------------------------------------------------


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 18):  # a multiple of 8 ids ends on a byte
        spread = np.unpackbits(ids[i : i + (1 << 18)].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(packed: np.ndarray, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` on, reading only their own bytes."""
    if bits in (8, 16, 32):
        width = bits // 8
        return packed[first * width : (first + count) * width].view(f"<u{width}").astype(np.uint32)
    out = []
    for i in range(first, first + count, 1 << 18):
        n = min(1 << 18, first + count - i)
        lo, hi = i * bits, (i + n) * bits
        raw = np.unpackbits(packed[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + n * bits].reshape(n, bits)
        wide = np.zeros((n, 32), dtype=np.uint8)
        wide[:, :bits] = raw
        out.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


class Block:
    """A packed block; nothing is unpacked until it is asked for."""

    def __init__(self, body: bytes):
        if body[:4] != MAGIC:
            raise ValueError("not a packed block")
        raw = np.frombuffer(body, dtype=np.uint8)
        self.bits = int(raw[4])
        n, self.n_tokens = (int(x) for x in raw[8:24].view("<u8"))
        at = 24
        self.doc_ids, at = raw[at : at + 8 * n].view("<i8"), at + 8 * n
        self.nulls, at = raw[at : at + n].astype(bool), at + -(-n // 8) * 8
        self.offsets, at = raw[at : at + 8 * (n + 1)].view("<u8").astype(np.int64), at + 8 * (n + 1)
        self.packed = raw[at:]

    def all(self) -> np.ndarray:
        return unpack_bits(self.packed, self.bits, 0, self.n_tokens)

    def document(self, k: int) -> np.ndarray:
        a, b = self.offsets[k : k + 2]
        return unpack_bits(self.packed, self.bits, int(a), int(b - a))


def pack_block(doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, offsets: np.ndarray, bits: int) -> bytes:
    n = len(doc_ids)
    head = MAGIC + bytes([bits, 0, 0, 0]) + np.array([n, len(ids)], "<u8").tobytes()
    flags = nulls.astype(np.uint8).tobytes() + bytes(-n % 8)
    return head + doc_ids.astype("<i8").tobytes() + flags + offsets.astype("<u8").tobytes() + pack_bits(ids, bits)


# --- encoding ---------------------------------------------------------------


class WordEncoder:
    """Ids of single words, remembered in two generations of at most ``MOST_CACHED`` each.

    A full generation becomes the older one, and the one before it is dropped: words that
    come again move to the recent one and stay, words that came once are forgotten.

    Letters with closing signs are two tokens for the pre-tokenizer, so
    their ids are joined from two shorter entries; that this holds for a given
    tokenizer is tried on probes when it is loaded, and given up if it does not.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.split = True
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]  # of these none may lose its end
        self.split = all(self._whole(p) == self._word(p) for p in _PROBES) and not any(t[-1:] in _TRAILING for t in special if t)
        words = self.tokenizer.encode(b" \t".join(_PROBES).decode() + "\n", add_special_tokens=False).ids
        if array("I", words).tobytes() != b"".join(map(self._whole, _PROBES)):
            raise ValueError("the tokenizer does not drop white space; words cannot be encoded alone")

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _token(self, word: bytes) -> bytes:
        """Ids of one token of the pre-tokenizer, already in its normal form: the model alone is asked."""
        symbols = word.decode() if word.isascii() else word.decode("latin-1").translate(_BYTE_SYMBOLS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(_TRAILING)
        closing = word[len(core) :]
        if not self.split:
            return self._whole(word)
        if core.isalpha():  # of bytes: ASCII letters
            core = core.lower()
        else:
            text = core.decode()
            if not text or max(text) > _LATIN:
                return self._whole(word)
            text = unicodedata.normalize("NFC", text).lower()
            if not text.isalpha():
                return self._whole(word)  # digits, signs, and letters that turn into a letter and a mark
            core = text.encode()
        return self._token(core) + self._token(closing) if closing else self._token(core)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as unsigned 32-bit integers."""
        out = list(map(self.recent.get, words))
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                ids = self.older.pop(word, None)
                out[i] = ids = self._word(word) if ids is None else ids
                if len(self.recent) >= MOST_CACHED:
                    self.older, self.recent = self.recent, {}
                self.recent[word] = ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(column: pa.Array, words: WordEncoder, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``end_id``, and their offsets."""
    data, offsets = buffers(column)
    if b"<|" not in data.tobytes():  # special tokens are told by their case; all else is put in lower case anyway
        data = _LOWER[data]
    starts, ends, _ = word_bounds(data, offsets)
    if words.split:  # closing signs after a letter are a token of their own: fewer distinct words
        cut = ends.copy()
        closed = np.flatnonzero(_CLOSES[data[cut - 1]])
        for _ in range(MOST_SIGNS):  # back over the signs of the words that still end on one; words with more stay whole
            cut[closed] -= 1
            closed = closed[cut[closed] > starts[closed]]
            closed = closed[_CLOSES[data[cut[closed] - 1]]]
        cut = cut[(cut < ends) & (cut > starts) & _LETTER[data[np.maximum(cut - 1, 0)]]]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    bounds = np.searchsorted(starts, offsets)
    codes, distinct = word_codes(data, starts, ends)
    encoded = words.encode(distinct.to_pylist())
    size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    values = np.frombuffer(b"".join(encoded), np.uint32)
    first = (np.cumsum(size) - size).astype(np.int32)
    count = size[codes]
    stop = np.cumsum(count)
    total = int(stop[-1]) if len(stop) else 0
    ids = values[np.repeat(first[codes] - (stop - count).astype(np.int32), count) + np.arange(total, dtype=np.int32)]
    cuts = np.concatenate([[0], stop])[bounds]
    if end_id is not None:
        ids = np.insert(ids, cuts[1:], end_id)
        cuts = cuts + np.arange(len(cuts))
    return ids, cuts


# --- files ------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the packed blocks in ascending order of the document id."""
    n = partitions(ready(docs))
    texts = texts_of(docs, id_col, text_col, F.xxhash64(text_col).alias("hash"))
    ordered = texts.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, "text", BLOCK_BYTES)):
            ids, offsets = encode_texts(block["text"], words, end_id)
            nulls = block["doc_id"].is_null().to_numpy(zero_copy_only=False)
            doc_ids = block["doc_id"].fill_null(0).to_numpy()
            body = pack_block(doc_ids, nulls, ids, offsets, bits_for(max(words.vocabulary, (end_id or 0) + 1)))
            known = doc_ids[~nulls]
            ends = [int(known[0]), int(known[-1])] if len(known) else [None, None]
            row = [part, k, *ends, block.num_rows, len(ids), body]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

    ordered.mapInArrow(run, BLOCK_SCHEMA).write.options(**GROUPS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks as they are stored."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def documents(stored: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document, ``start`` being the ids of all documents before it."""
    ready(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, body in zip(batch["part"].to_pylist(), batch["block"].to_pylist(), batch["body"], strict=True):
                b = Block(body.as_buffer().to_pybytes())
                n = len(b.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int64)), pa.array(b.doc_ids, pa.int64(), mask=b.nulls),
                        pa.array(b.offsets[:-1]), pa.ListArray.from_arrays(pa.array(b.offsets, pa.int32()), pa.array(b.all().astype(np.int64))),
                    ],
                    names=["part", "block", "doc_id", "within", "ids"],
                )

    rows = stored.select("part", "block", "body").mapInArrow(run, "part int, block long, doc_id long, within long, ids array<long>")
    return rows.join(starts(stored), ["part", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "ids")


def starts(stored: DataFrame) -> DataFrame:
    """(part, block, base): the ids before each block. Ranges are added up first: their number is that of the partitions."""
    sizes = stored.select("part", "block", "n_tokens")
    ranges = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner_base"))
    return broadcast_if_small(sizes.join(F.broadcast(ranges), "part").select("part", "block", (F.col("range_base") + F.col("inner_base")).alias("base")))


def summaries(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): like ``documents``, but the ids stay in the tasks as a checksum (unsigned 32-bit, little-endian)."""
    ready(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, body in zip(batch["part"].to_pylist(), batch["block"].to_pylist(), batch["body"], strict=True):
                b = Block(body.as_buffer().to_pybytes())
                raw = memoryview(b.all().astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True)]
                n = len(b.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int64)), pa.array(b.doc_ids, pa.int64(), mask=b.nulls),
                        pa.array(b.offsets[:-1]), pa.array(np.diff(b.offsets)), pa.array(sums, pa.int64()),
                    ],
                    names=["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    rows = stored.select("part", "block", "body").mapInArrow(run, "part int, block long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts(stored), ["part", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def lookup(stored: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, from the blocks that can hold it and only its own bytes of them."""
    out = []
    for r in stored.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("body").toLocalIterator():
        b = Block(bytes(r["body"]))
        out += [b.document(int(k)) for k in np.flatnonzero((b.doc_ids == doc_id) & ~b.nulls)]
    return out
