"""Prefix trie of conversations by ROLLUP over positional turn columns (operator 11).

A turn is known by an id of its role and text, 128 bits of a SHA-256 hash. A
conversation is laid out in blocks of ``WIDTH`` turns, one row for each block
with the ids in positional columns ``t1..t8`` and, as ``key``, the node where the
block before ended. ``GROUP BY block, key, ROLLUP (t1, .., t8)`` aggregates every
prefix of every conversation at once, and ``grouping`` tells a prefix's length.
The nodes of all blocks come from one pass, whatever the longest conversation:
the key of a block is the hash of all ids before it, taken in groups of ``GROUP``
blocks and then in groups of groups, so no row holds a whole conversation and no
loop follows its turns.

A first rollup gives the nodes (members, smallest member). A node's own figures
are put on its smallest member at its depth, summed from the end of each
conversation, and a second rollup over the same rows adds them up for every node:
the sums over subtrees. Ids of conversations that end at a node are joined in
ranges of 4,096 ids first; one streaming pass hashes the ranges in order.

A key that holds a third of all rows is no hot task: places within a
conversation come from a range sort, blocks are grouped by (conversation, group),
rollups combine before they shuffle, and joins on a hot node have one row on the
other side and can be split.

Defined results: turns are in the order of (turn, id of role and text), a null
turn first; a null role or text is empty; repeated rows are repeated turns; a row
with a null conversation id belongs to no conversation. Very long conversations
only add blocks, very long texts are hashed where they stand. An empty table gives no
nodes (the root has a smallest member only if there is a conversation).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored

WIDTH = 8  # positional columns of a block
GROUP = 64  # blocks, or groups, whose ids are in one row
IDS = [f"t{k}" for k in range(1, WIDTH + 1)]
RANGE_BITS = 12  # conversation ids are joined in ranges of 4,096
NO_IDS = hashlib.sha256(b"").hexdigest()
_LOW = (1 << 33) - 1


def turn_ids(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, tid, bytes): a turn by the hash of its role and text, and its text's size."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    tid = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), tid.alias("tid"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id is not null")


def placed(ids: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, bytes): the place of each turn in its conversation, from 0, without one task for a conversation.

    The rows are sorted by range and written; a partition numbers its own rows, and a
    prefix sum over (conversation, partition) adds what stands in partitions before.
    """
    order = ["conv_id", "turn", "tid"]
    at = F.monotonically_increasing_id()
    sorted_ = ids.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = stored(sorted_.select("conv_id", "tid", "bytes", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit(_LOW)).alias("place")), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tagged.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return tagged.join(stored(parts, "trie-parts"), ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("shift")).alias("pos"), "tid", "bytes")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed turns as the paths of a trie, each with its conversation's length, and the conversations (conv_id, n)."""
    sizes = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    return turns.join(sizes, "conv_id"), sizes


def spliced(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their first turns: c begins with the first h turns of c - c % every, then has its own after its first h.

    h is the crc32 of the decimal id modulo ``most``. Returned as by ``whole``.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % F.lit(most)
    sizes = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("own"))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "bytes"))).alias("head"))
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(heads.schema["head"].dataType)))
    convs = convs.withColumn("b", F.size("head").cast("long"))
    convs = stored(convs.select("conv_id", "head", "h", "b", (F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-conversations")
    heads = convs.select("conv_id", "n", F.inline("head"))
    own = turns.where(F.col("pos") >= h).join(convs.select("conv_id", "h", "b", "n"), "conv_id")
    own = own.select("conv_id", "n", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "tid", "bytes")
    return heads.unionByName(own), convs.select("conv_id", "n")


def _joined(*parts) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def chained(items: DataFrame) -> DataFrame:
    """(conv_id, j, key, next) from (conv_id, j, digest): the hash of the digests before an item, and with its own.

    Hashes are taken over at most ``GROUP`` digests and the key of their group, which comes from the digests of whole groups.
    """
    last = items.agg(F.max("j")).first()[0] or 0
    packs = items.groupBy("conv_id", F.floor(F.col("j") / GROUP).alias("g")).agg(F.array_sort(F.collect_list(F.struct("j", "digest"))).alias("xs"))
    if last >= GROUP:
        above = chained(packs.select("conv_id", F.col("g").alias("j"), _joined("xs.digest").alias("digest")))
        packs = packs.join(above.withColumnRenamed("j", "g"), ["conv_id", "g"])
    else:
        packs = packs.withColumns({"key": F.lit(""), "next": F.lit(None).cast("string")})
    before = lambda m: _joined("key", F.slice(F.col("xs.digest"), F.lit(1), m))

    def one(x: Column, m: Column) -> Column:
        key = F.when(m == 0, F.col("key")).otherwise(before(m))
        end = F.when((m == GROUP - 1) & F.col("next").isNotNull(), F.col("next")).otherwise(before(m + 1))
        return F.struct(x["j"].alias("j"), key.alias("key"), end.alias("next"))

    return packs.select("conv_id", F.inline(F.transform("xs", one)))


def blocks(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n, block, key, next, t1..t8, b1..b8), a row for each ``WIDTH`` turns and one for a conversation without turns."""
    size = WIDTH * GROUP
    rows = paths.select("conv_id", "n", F.floor(F.col("pos") / size).alias("j"), F.struct("pos", "tid", "bytes").alias("x"))
    empty = convs.select("conv_id", "n", F.lit(0).cast("long").alias("j"), F.lit(None).cast(rows.schema["x"].dataType).alias("x"))
    # a hot conversation is dealt by its groups, not with the join before
    packs = rows.unionByName(empty).repartition("conv_id", "j").groupBy("conv_id", "j").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("x")).alias("xs"))
    packs = stored(packs, "trie-groups")
    keys = chained(packs.select("conv_id", "j", _joined("xs.tid").alias("digest")))
    packs = packs.join(keys, ["conv_id", "j"])
    last = F.greatest(F.ceil(F.size("xs") / WIDTH), F.lit(1)).cast("int")
    one = packs.select("*", F.explode(F.sequence(F.lit(0), last - 1)).alias("m"))
    before = lambda m: F.when(m == 0, F.col("key")).otherwise(_joined("key", F.slice(F.col("xs.tid"), F.lit(1), m * WIDTH)))
    turn = lambda k, name: F.get(F.col("xs"), F.col("m") * WIDTH + k)[name]
    m = F.col("m")
    return one.select(
        "conv_id", "n", (F.col("j") * GROUP + m).alias("block"), before(m).alias("key"),
        F.when(m == GROUP - 1, F.col("next")).otherwise(before(m + 1)).alias("next"),
        *[turn(k, "tid").alias(f"t{k + 1}") for k in range(WIDTH)], *[turn(k, "bytes").alias(f"b{k + 1}") for k in range(WIDTH)],
    )


def rolled(rows: DataFrame, measures: str) -> DataFrame:
    """One row for each node: (block, level, node, parent, t, and the measures), from one ROLLUP over the positional columns.

    A measure may name ``level``'s column as ``{level of x}``: it is taken from the columns x0..x8 (or x1..x8) by the prefix's length.
    """
    level = " + ".join(f"(1 - grouping({t}))" for t in IDS)
    found = rows.sparkSession.sql(
        f"select block, key, {', '.join(IDS)}, next, {level} as level, {measures} from {{rows}} "
        f"group by block, key, rollup({', '.join(IDS[:-1])}, ({IDS[-1]}, next))",
        rows=rows,
    )
    ids = F.array(*IDS)
    found = found.where("(level = 0 and block = 0) or (level > 0 and element_at(array(" + ", ".join(IDS) + "), greatest(level, 1)) is not null)")
    prefix = lambda k: _joined("key", F.slice(ids, F.lit(1), k))
    level = F.col("level").cast("int")
    node = F.when(level == 0, F.col("key")).when(level == WIDTH, F.col("next")).otherwise(prefix(level))
    parent = F.when(level == 1, F.col("key")).when(level > 1, prefix(level - 1))
    return found.withColumns({"level": level, "node": node, "parent": parent, "depth": F.col("block") * WIDTH + level}).drop(*IDS, "next", "key")


def _of_level(name: str, how: str, start: int = 1) -> str:
    return ", ".join(f"{how}({name}{k}) as {name}{k}" for k in range(start, WIDTH + 1))


def _at_level(name: str, start: int = 1) -> Column:
    out = F.lit(0).cast("long")
    for k in range(start, WIDTH + 1):
        out = F.when(F.col("level") == k, F.col(f"{name}{k}")).otherwise(out)
    return out


def after(items: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, j, values): for each item the sums over the later items of its conversation, by groups and groups of groups."""
    last = items.agg(F.max("j")).first()[0] or 0
    rows = items.withColumn("g", F.floor(F.col("j") / GROUP))
    later = Window.partitionBy("conv_id", "g").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", "j", "g", *[F.coalesce(F.sum(v).over(later), F.lit(0)).alias(v) for v in values])
    if last >= GROUP:
        totals = items.groupBy("conv_id", F.floor(F.col("j") / GROUP).alias("j")).agg(*[F.sum(v).alias(v) for v in values])
        above = after(totals, values).select("conv_id", F.col("j").alias("g"), *[F.col(v).alias(f"above_{v}") for v in values])
        rows = rows.join(above, ["conv_id", "g"]).withColumns({v: F.col(v) + F.col(f"above_{v}") for v in values})
    return rows.select("conv_id", "j", *values)


def end_hashes(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) for nodes where conversations end: their ids in ascending order, joined by commas and hashed."""
    ended = F.col("n") - F.col("block") * WIDTH
    last = rows.where((ended <= WIDTH) & ((ended > 0) | (F.col("n") == 0)))
    node = F.when(F.col("n") == 0, F.col("key")).when(ended == WIDTH, F.col("next")).otherwise(_joined("key", F.array_compact(F.array(*IDS))))
    ids = last.select(node.alias("node"), "conv_id", F.shiftright("conv_id", RANGE_BITS).alias("range"))
    ranges = ids.groupBy("node", "range").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for at, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if at != node:
                    if running:
                        done.append((node, running.hexdigest()))
                    node, running = at, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"node": a, "ends_sha256": b} for a, b in done])
        if running:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": running.hexdigest()}])

    return ranges.repartition("node").sortWithinPartitions("node", "range").select("node", "ids").mapInArrow(digest, "node string, ends_sha256 string")


def nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    ready(paths)
    rows = stored(blocks(paths, convs), "trie-blocks")
    found = rolled(rows, f"count(*) as n_convs, min(conv_id) as conv_id, {_of_level('b', 'min')}")
    found = stored(found.select("node", "parent", "block", "level", "depth", "conv_id", "n_convs", _at_level("b").alias("bytes")), "trie-nodes")
    children = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    found = stored(found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-families")
    # a node's figures on its smallest member, at its depth
    weight, leaf = (F.col("n_convs") - 1) * F.col("bytes"), (F.col("n_children") == 0).cast("long")
    home = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.floor((F.col("depth") - 1) / WIDTH))
    own = found.groupBy("conv_id", home.alias("block")).agg(
        F.sum(leaf).alias("leaves"), *[F.coalesce(F.sum(F.when(F.col("level") == k, weight)), F.lit(0)).alias(f"w{k}") for k in range(1, WIDTH + 1)]
    )
    marked = rows.join(own, ["conv_id", "block"], "left").na.fill(0, ["leaves", *[f"w{k}" for k in range(1, WIDTH + 1)]])
    saved = sum((F.col(f"w{k}") for k in range(1, WIDTH + 1)), F.lit(0))
    marked = stored(marked.withColumn("saved", saved), "trie-marked")
    later = after(marked.select("conv_id", F.col("block").alias("j"), "saved", "leaves"), ["saved", "leaves"])
    later = later.select("conv_id", F.col("j").alias("block"), F.col("saved").alias("later"), F.col("leaves").alias("later_leaves"))
    marked = marked.join(later, ["conv_id", "block"])
    tail = lambda k: sum((F.col(f"w{i}") for i in range(max(k, 1), WIDTH + 1)), F.col("later"))
    marked = marked.select("block", "key", *IDS, "next", (F.col("leaves") + F.col("later_leaves")).alias("leaves"), *[tail(k).alias(f"s{k}") for k in range(WIDTH + 1)])
    sums = rolled(marked, f"sum(leaves) as n_leaves, {_of_level('s', 'sum', 0)}").select("node", "n_leaves", _at_level("s", 0).alias("saved_tokens"))
    up = found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = found.join(up, "parent", "left").join(sums, "node").join(end_hashes(rows), "node", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
