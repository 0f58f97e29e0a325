"""Benchmark decontamination as a prefix-filtered set join (operator 10), in DataFrame functions only.

An item gives windows of ``window`` consecutive words (or itself, if shorter).
A window occurs in a document only if the document holds all of its words, so a
prefix of one word is enough for the join: the words of a window are ordered by
how often the corpus has them, and only the rarest is joined. Its offset in the
window fixes where the window would start; starts before the first word or
windows past the last word are dropped (positional and length bounds). What is
left is compared word by word with the document's slice of the window's size.
Candidates carry a window alone; the items that hold it are joined to the windows that
do occur, after the comparison.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case. The join key is the word in full Unicode lower case, with the one letter
whose lower case depends on its neighbours (the Greek final sigma) made one: texts
equal in A-Z lower case are equal there too, so nothing is lost, and the
comparison at the end uses A-Z alone. Rarity decides only which word is joined, never the result.

Defined results: a null text has no words, is not hit and is not contaminated; a
null id is an ordinary id; each input row gives one row, also if rows repeat; an
item without words has no windows; equal windows of several items count for
each item; items of a null id occur without being named. Empty documents give
an empty result, and an empty benchmark gives no hits. All other columns of the
documents pass through; one that has the name of an added column gives way to it
in ``decontaminate`` and stays in ``clean``, which adds none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that is no word character once A-Z are lower case, so A-Z stay in.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")


def words(text: Column) -> Column:
    """The words in their order and case; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def fold(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def joined(text: Column) -> Column:
    """The form that words are joined in; a word has the same one alone and within its text."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): the distinct windows of each item."""
    w = items.select(F.col(id_col).cast("string").alias("item"), F.transform(words(F.col(text_col)), fold).alias("all"))
    w = w.where(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    starts = F.transform(F.sequence(F.lit(1), last + 1), lambda s: F.slice("all", s, window))
    return w.select("item", F.explode(F.array_distinct(starts)).alias("words"))


def rarest(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Windows with their rarest word ``token`` and its ``offset``, by the corpus count of each word."""
    vocabulary = broadcast_if_small(found.select(F.explode("words").alias("word")).select(joined(F.col("word")).alias("word")).distinct())
    # explode_outer: for explode, the planner would split every text a second time to drop empty arrays
    seen = texts.select(F.explode_outer(words(joined(F.col("text")))).alias("word")).join(vocabulary, "word", "left_semi")
    # counted and stored first: a word of many windows then does not share its task with the count
    seen = broadcast_if_small(stored(seen.groupBy("word").agg(F.count("*").alias("n")), "word-counts"))
    each = found.select("words", F.posexplode("words").alias("offset", "w")).select("words", "offset", joined(F.col("w")).alias("word"))
    # A word that the corpus lacks is the rarest: its windows then join nothing.
    ranked = each.join(seen, "word", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("offset"))).alias("r")
    )
    # Windows of a missing word cannot occur at all.
    return ranked.where(F.col("r.n") > 0).select(F.col("r.word").alias("token"), F.col("r.offset").alias("offset"), "words")


def judge(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """``row`` (all columns of a document, as a struct, so that no name can clash), ``n_words``, ``n_hit`` and ``hits``, the distinct ``words`` of ``found`` that occur."""
    key = F.xxhash64(F.col(text_col))  # equal texts have equal windows; a clash only adds candidates, which are compared
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prefixes = broadcast_if_small(rarest(found.select("words").distinct(), texts))
    split = texts.select("key", words(joined(F.col("text"))).alias("w")).select("key", "w", F.size("w").alias("n"))
    tokens = split.select("key", "n", F.posexplode_outer("w").alias("pos", "token"))
    start = F.col("pos") - F.col("offset")
    candidates = (
        tokens.join(prefixes, "token")
        .where((start >= 0) & (start + F.size("words") <= F.col("n")))
        .groupBy("key")
        .agg(F.collect_set(F.struct(start.alias("start"), "words")).alias("found"))
    )

    def verdict(w: Column, hits: Column) -> Column:
        hit = F.array_distinct(F.flatten(F.transform(hits, lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1))))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.coalesce(F.size(hit), F.lit(0)).cast("long").alias("n_hit"),
            F.array_distinct(F.transform(hits, lambda c: c["words"])).alias("hits"),
        )

    def same(w: Column) -> Column:
        return F.when(F.col("found").isNotNull(), F.filter("found", lambda c: F.transform(F.slice(w, c["start"] + 1, F.size(c["words"])), fold) == c["words"]))

    judged = bind(words(F.col("text")), lambda w: bind(same(w), lambda hits: verdict(w, hits)))
    return rows.join(candidates, "key", "left").select("row", judged.alias("v")).select("row", "v.*")


def contaminated(hits_per_word: int) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * hits_per_word >= F.col("n_words"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: a column used twice would be split anew for each use (and each element of a lambda)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    hits_per_word: int = 20,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as text) and ``contaminated``.

    A document is contaminated if it is hit and ``hits_per_word * n_hit >= n_words``.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    found = windows(items, item_id_col, item_text_col, window)
    judged = stored(judge(docs, found, text_col).withColumn("hit_set", F.xxhash64("hits")), "judged")
    # The items of windows that do occur, once for each set of windows and not for each document that holds it.
    sets = judged.where("n_hit > 0").select("hit_set", "hits").distinct()
    named = sets.select("hit_set", "hits", F.explode("hits").alias("words")).join(found.distinct(), "words")
    named = named.groupBy("hit_set", "hits").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rest = judged.where("n_hit = 0").select("row", "n_words", "n_hit", F.array().cast("array<string>").alias("items"))
    hit = judged.where("n_hit > 0").join(named, ["hit_set", "hits"], "left")
    hit = hit.select("row", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = rest.unionByName(hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", contaminated(hits_per_word))
    return out.select(*[F.col(f"row.`{c}`") for c in kept], *ADDED)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, hits_per_word: int = 20) -> DataFrame:
    """The documents that are not contaminated, with exactly their own columns."""
    judged = judge(docs, windows(items, item_id_col, item_text_col, window), text_col)
    return judged.where(~contaminated(hits_per_word)).select("row.*")
