"""Cheapest repair of conversation structure by secondary-sorted streaming (operator 13).

A conversation should be ``(s?(ua)+)?``: nothing, or pairs of a user's and an
assistant's turn, after a system turn or not. Each row is kept, given another role,
or deleted, and empty turns are inserted, at the least cost (``COSTS``). Blank rows
and repeats must go; a truncated row that stays costs 1 more.

The rows are dealt by conversation and sorted by turn, and ``mapInPandas`` carries a
dynamic program across Arrow batches. Its state is the least cost of the rest of the
conversation from each of the four places of the pattern, so the rows come last turn
first, without their texts. Each row leaves two bytes: the best first edit
from each place, and what the row's role can be. They stay in memory up to
``HELD_BYTES`` and go to an unlinked temporary file of the task beyond that, the way
Spark's own sorts spill. When a conversation is whole, one walk from its first row
reads the bytes back and gives the edits, in pieces. A second stream, first turn
first, lays the edits beside the texts; it holds one piece of edits at a time.

Taking the first letter in ASCII order among the best edits at each step gives the
least audit string of all cheapest repairs: what has been read fixes the place.

Defined results: a null role or text is one space, in the damage key a null id or
turn too; a null id is one conversation; rows are in the order of (turn, hash of role and text),
a null turn first; the initial of a role is its first character, an empty role has
none and can be kept without effect. Repeated rows are duplicates, all but the
first. A conversation without rows is empty: zeros, no edits. A very long
conversation is one task's stream, as the method says; memory stays bounded. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready

#: What an edit costs, and what a truncated row adds if it stays.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
#: Fixed: from each place of the pattern, the place after a system, user or assistant turn (9: not allowed).
#: Places: 0 nothing yet, 1 after the system turn, 2 after a user's turn, 3 after a pair.
NEXT = {"s": (1, 9, 9, 9), "u": (2, 2, 9, 2), "a": (9, 9, 3, 9)}
GIVEN = ("u", "u", "a", "u")  # the only role that an inserted or renamed turn can have there
DONE = (0, 3)
EDITS = "DIKR"  # in ASCII order: ties go to the first
INITIALS = ("", "s", "u", "a", "?")
NEVER = 1 << 40
HELD_BYTES = 4 << 20
PIECE = 4096  # rows whose edits travel in one piece
WORD = r"[^\x20\x09-\x0D]"
SENTENCE_END = r"[.!?][\x20\x09-\x0D]*\z"


class Tape:
    """Two bytes for each row, read back from the last; spilled to an unlinked file beyond ``HELD_BYTES``."""

    def __init__(self):
        self.held, self.file = bytearray(), None

    def add(self, choices: int, initial: int) -> None:
        self.held += bytes((choices, initial))
        if len(self.held) >= HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held.clear()

    def backwards(self) -> Iterator[tuple[int, int]]:
        end = self.file.tell() if self.file else 0
        yield from _pairs_back(self.held)
        while end:
            size = min(HELD_BYTES, end)
            end -= size
            self.file.seek(end)
            yield from _pairs_back(self.file.read(size))
        if self.file:
            self.file.close()


def _pairs_back(body: bytes) -> Iterator[tuple[int, int]]:
    for i in range(len(body) - 2, -1, -2):
        yield body[i], body[i + 1]


def _inserted(cost: tuple[int, ...]) -> tuple[int, ...]:
    """The least costs when turns may be inserted first; two inserted turns lead back to the same place."""
    for _ in range(2):
        cost = tuple(min(cost[q], COSTS["I"] + cost[NEXT[GIVEN[q]][q]]) for q in range(4))
    return cost


FINAL = _inserted(tuple(0 if q in DONE else NEVER for q in range(4)))


@functools.lru_cache(4096)
def _step(rest: tuple[int, ...], initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, ...], int]:
    """The least costs with one more row before, and the best first edit from each place, two bits each."""
    extra = TRUNCATED_COST if truncated else 0
    ways = []
    for q in range(4):
        to = q if initial == "" else NEXT[initial][q] if initial in NEXT else 9
        keep = NEVER if must_go or to == 9 else COSTS["K"] + extra + rest[to]
        role = NEVER if must_go else COSTS["R"] + extra + rest[NEXT[GIVEN[q]][q]]
        ways.append({"D": COSTS["D"] + rest[q], "K": keep, "R": role})
    cost = _inserted(tuple(min(w.values()) for w in ways))
    choices = 0
    for q in range(4):
        ways[q]["I"] = COSTS["I"] + cost[NEXT[GIVEN[q]][q]]
        choices |= next(i for i, e in enumerate(EDITS) if ways[q][e] == cost[q]) << 2 * q
    return cost, choices


def _end(place: int) -> str:
    """What must be inserted after the last row."""
    out = ""
    while place not in DONE:
        out, place = out + "I", NEXT[GIVEN[place]][place]
    return out


def _walk(tape: Tape) -> Iterator[str]:
    """The edits of each row from the first, those inserted before it in front; last, what is inserted at the end."""
    place = 0
    for choices, initial in tape.backwards():
        out = ""
        while True:
            edit = EDITS[choices >> 2 * place & 3]
            out += edit
            if edit in "IR":
                place = NEXT[GIVEN[place]][place]
            elif edit == "K" and INITIALS[initial]:
                place = NEXT[INITIALS[initial]][place]
            if edit != "I":
                break
        yield out
    yield _end(place)


class Conversation:
    """What a stream carries of one conversation, last turn first."""

    def __init__(self, key: tuple):
        self.key, self.rest, self.spent, self.tape = key, FINAL, 0, Tape()
        self.later: tuple | None = None
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.most = self.least = None
        self.marks: list[tuple] = []  # where pieces begin: a row's order, every PIECE rows from the end

    def add(self, no_turn: bool, turn: int, content: str, initial: str, blank: bool, repeated: bool, cut: bool) -> None:
        repeated, cut = repeated and not blank, cut and not blank and not repeated
        self.rows += 1
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut
        if self.later is not None:
            self.illegal += initial + self.later[0] not in ("su", "ua", "au")
        if not no_turn:
            self.turns += self.later is None or turn != self.later[1]
            self.most = turn if self.most is None else self.most
            self.least = turn
        self.later = (initial, turn)
        cost, choices = _step(self.rest, initial, blank or repeated, cut)
        least = min(cost)  # only differences are carried, so a few states come again and again
        self.rest, self.spent = tuple(c - least for c in cost), self.spent + least
        self.tape.add(choices, INITIALS.index(initial if initial in INITIALS else "?"))
        self.first = (no_turn, turn, content)
        if self.rows % PIECE == 0:
            self.marks.append(self.first)

    def pieces(self) -> Iterator[tuple]:
        """(conversation, order of the first row, piece, edits, figures): the edits of ``PIECE`` rows, of fewer in the first piece."""
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        figures = [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.spent + self.rest[0]]
        head = self.rows % PIECE
        begins = ([self.first] if head else []) + self.marks[::-1]
        entries = _walk(self.tape)
        for piece, order in enumerate(begins):
            size = head if head and not piece else PIECE
            held = [next(entries) for _ in range(size)]
            if piece == len(begins) - 1:
                held += entries  # what is inserted at the end
            yield (*self.key, *order, piece, held, figures)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
KEY = ["no_conv", "conv"]
PIECES = "no_conv boolean, conv long, no_turn boolean, turn long, content string, piece long, edits array<string>, figures array<long>"
TURNS = "no_conv boolean, conv long, pos long, role string, text string, edit string"
DIGESTS = "no_conv boolean, conv long, figures array<long>, audit string, repaired_sha256 string"


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table's rows with the faults that the crc32 of ``conv_id:turn`` modulo 20 names: dropped, emptied, without ``[.!?]``, repeated, or role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col))) % 20
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space(role_col)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col)).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"), kind.alias("kind"),
    )
    return rows.where("kind != 0").drop("copy", "kind")


def known(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows in plain columns, with a hash of role and text, which also orders rows of one turn."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    content = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))  # noqa: E731 - pandas has no exact long with nulls
    return rows.select(
        F.col(id_col).isNull().alias("no_conv"), number(id_col).alias("conv"), (~F.col(turn_col).isNull()).alias("has_turn"), number(turn_col).alias("turn"),
        role.alias("role"), text.alias("text"), content.alias("content"),
    ).withColumn("no_turn", ~F.col("has_turn")).drop("has_turn")


def _streamed(stream: Callable, rows: DataFrame, order: list[Column], schema: str) -> DataFrame:
    """Secondary sort: dealt by conversation, sorted within, and read as one stream a partition."""
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, *order).mapInPandas(stream, schema)


def _tuples(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].tolist() for c in batch.columns), strict=True)


def _frames(rows: Iterator[tuple], schema: str, size: int = 1000) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in schema.split(", ")]
    while held := list(itertools.islice(rows, size)):
        yield pd.DataFrame(held, columns=names)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, in pieces (``PIECES``): an entry for each row, with turns inserted before it in front, and one for the end.

    ``rows`` are as ``known`` gives them. A piece carries the order of its first row and the conversation's figures.
    """
    ready(rows)
    first = F.row_number().over(Window.partitionBy(*KEY, "content").orderBy(F.col("no_turn").desc(), "turn")) == 1
    facts = rows.select(
        *KEY, "no_turn", "turn", "content", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(WORD)).alias("blank"), (~first).alias("repeated"), (~F.col("text").rlike(SENTENCE_END)).alias("cut"),
    )

    def all_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now = None
        for no_conv, conv, *row in _tuples(batches):
            if now is None or now.key != (no_conv, conv):
                if now is not None:
                    yield from now.pieces()
                now = Conversation((no_conv, conv))
            now.add(*row)
        if now is not None:
            yield from now.pieces()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(all_pieces(batches), PIECES)

    return _streamed(stream, facts, [F.col("no_turn").asc(), F.col("turn").desc(), F.col("content").desc(), F.col("repeated").desc()], PIECES)


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conversation, figures, None, None, None) as one begins, then (conversation, None, edit, role, text) for each edit in order."""
    at, queue, place = None, deque(), 0
    named = {"u": "user", "a": "assistant"}

    def done(entry: str, role: str = "", text: str = "") -> Iterator[tuple]:
        nonlocal place
        for edit in entry:
            given = GIVEN[place]
            if edit == "K":
                place = NEXT[role[:1]][place] if role else place
                yield at, None, edit, role, text
            elif edit == "D":
                yield at, None, edit, role, text
            else:
                place = NEXT[given][place]
                yield at, None, edit, named[given], text if edit == "R" else ""

    for no_conv, conv, role, text, given, figures in _tuples(batches):
        if (no_conv, conv) != at:
            if at is not None:
                yield from done(queue.popleft())
            at, place = (no_conv, conv), 0
            queue.clear()
            yield at, figures, None, None, None
        if given is not None:
            queue.extend(given)
        else:
            yield from done(queue.popleft(), role, text)
    if at is not None:
        yield from done(queue.popleft())


def _laid_beside(rows: DataFrame, pieces: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Rows and pieces of edits in one frame, and the order in which a piece comes before its first row."""
    none = lambda kind: F.lit(None).cast(kind)
    one = rows.select(*KEY, "role", "text", none("array<string>").alias("edits"), none("array<long>").alias("figures"), "no_turn", "turn", "content", F.lit(1).alias("is_row"), F.lit(0).cast("long").alias("piece"))
    other = pieces.select(*KEY, F.lit("").alias("role"), F.lit("").alias("text"), "edits", "figures", "no_turn", "turn", "content", F.lit(0).alias("is_row"), "piece")
    return one.unionByName(other), [F.col("no_turn").desc(), F.col("turn"), F.col("content"), F.col("is_row"), F.col("piece")]


def _beside(stream: Callable, rows: DataFrame, pieces: DataFrame, schema: str) -> DataFrame:
    both, order = _laid_beside(rows, pieces)
    out = _streamed(lambda batches: stream(b[[*KEY, "role", "text", "edits", "figures"]] for b in batches), both, order, schema)
    return out.withColumn("conv_id", F.when(~F.col("no_conv"), F.col("conv"))).drop(*KEY)


def repaired(turns: DataFrame, **columns) -> DataFrame:
    """The repaired conversations: (conv_id, pos, role, text, edit), deleted rows left out."""
    rows = known(turns, **columns)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        pos = 0
        for at, figures, edit, role, text in _edited(batches):
            if figures is not None:
                pos = 0
            elif edit != "D":
                yield (*at, pos, role, text, edit)
                pos += 1

    return _beside(lambda batches: _frames(kept(batches), TURNS), rows, edits(rows), TURNS).select("conv_id", "pos", "role", "text", "edit")


def summaries(turns: DataFrame, **columns) -> DataFrame:
    """One row for each conversation that has rows: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    rows = known(turns, **columns)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        last, figures, audit, body, lines = None, None, [], None, 0
        for at, begun, edit, role, text in _edited(batches):
            if begun is not None:
                if last is not None:
                    yield (*last, figures, "".join(audit), body.hexdigest())
                last, figures, audit, body, lines = at, begun, [], hashlib.sha256(), 0
                continue
            audit.append(edit)
            if edit != "D":
                body.update((("\n" if lines else "") + role + ":" + text).encode())
                lines += 1
        if last is not None:
            yield (*last, figures, "".join(audit), body.hexdigest())

    out = _beside(lambda batches: _frames(digests(batches), DIGESTS), rows, edits(rows), DIGESTS)
    return out.select("conv_id", *[F.get("figures", F.lit(i)).alias(name) for i, name in enumerate(FIGURES)], "audit", "repaired_sha256")


def repair(turns: DataFrame, changed: DataFrame, id_col: str = "conv_id", **columns) -> DataFrame:
    """``summaries`` of ``changed`` for every conversation of ``turns``; one that has no rows left is empty."""
    every = turns.select(F.col(id_col).alias("conv_id")).distinct()
    found = summaries(changed, id_col=id_col, **columns).withColumnRenamed("conv_id", "id")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    return out.na.fill(0, list(FIGURES)).na.fill({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
