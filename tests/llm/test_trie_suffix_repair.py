"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventpipe.llm import prefix_trie, repair, suffix_dedup
from eventpipe.llm.suffix_array import permuted_prefixes, suffix_array

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


def content(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ---------------------------------------------------------------------


def random_turns(seed):
    r, rows = random.Random(seed), []
    for c in [*range(-6, 30), 10**12, 10**12 + 3]:
        for t in range(r.choice([0, 1, 2, 5, 8, 9, 16, 20, 70])):
            rows.append((c if r.random() < 0.97 else None, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "é", None, "", "long " * 30])))
    return rows + rows[:4]


def rebuilt(rows, splice):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, content(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in by.items()}
    if not splice:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - int(c - 5 * int(c / 5)), [])[: h[c]] + w[h[c] :] for c, w in own.items()}


def brute_trie(paths):
    members, kids, leaves, saved = (defaultdict(x) for x in (list, list, int, int))
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += not kids[p]
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))))
            for p, m in members.items()
        ),
        key=str,
    )


@pytest.mark.parametrize(("seed", "group", "splice"), [(0, 64, True), (1, 2, True), (2, 2, False)])
def test_trie(spark, monkeypatch, seed, group, splice):
    """Groups of two blocks make conversations of a few turns need groups of groups."""
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    rows = random_turns(seed)
    turns = prefix_trie.placed(prefix_trie.turn_ids(spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit("x"), "n": F.lit(1), "tid": F.lit(2)})))
    got = prefix_trie.nodes(*(prefix_trie.spliced(turns) if splice else prefix_trie.whole(turns)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_trie(rebuilt(rows, splice))


def test_trie_of_a_long_conversation(spark):
    """4,500 turns: more than one group of 512; a very long text; another conversation that leaves it after 1,024 turns."""
    one = [(1, i, "user", f"text {i}" if i else "long " * 200_000) for i in range(4500)]
    two = [(2, *r[1:]) for r in one[:1024]] + [(2, 2000, "user", "other")]
    rows = one + two
    turns = prefix_trie.placed(prefix_trie.turn_ids(spark.createDataFrame(rows, TURNS)))
    got = {(r.conv_id, r.depth): r for r in prefix_trie.nodes(*prefix_trie.whole(turns)).collect()}
    assert len(got) == 4502
    assert all(got[1, d].n_convs == 1 + (d <= 1024) for d in range(4501))
    assert (got[1, 1024].n_children, got[2, 1025].parent_conv_id, got[1, 0].n_leaves, got[1, 1025].n_leaves) == (2, 1, 2, 1)
    assert got[1, 0].saved_tokens == sum(len(r[3]) for r in one[:1024])


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([(None, 0, "user", "x")], TURNS)
    turns = prefix_trie.placed(prefix_trie.turn_ids(empty))
    assert prefix_trie.nodes(*prefix_trie.spliced(turns)).collect() == []


# --- 12 ---------------------------------------------------------------------


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(400):
        text = np.array([r.randrange(r.choice([2, 3, 5, 200])) for _ in range(r.randrange(1, 60))], np.uint8)
        if r.random() < 0.3:
            text = np.concatenate([text, text, text[: r.randrange(len(text))]])
        body = text.tobytes()
        want = sorted(range(len(body)), key=lambda i: body[i:])
        got = suffix_array(text)
        assert got.tolist() == want
        common = permuted_prefixes(text, got)
        for x, y in zip(want[:-1], want[1:], strict=True):
            n = 0
            while max(x, y) + n < len(body) and body[x + n] == body[y + n]:
                n += 1
            assert common[y] == n
    assert suffix_array(np.zeros(0, np.uint8)).tolist() == []


def random_bytes(seed, n=60):
    r = random.Random(seed)
    base, rows = "".join(r.choice("abcé ñ😀xyz\0") for _ in range(600)), []
    for i in range(n):
        text = ""
        for _ in range(r.randrange(0, 5)):
            a = r.randrange(0, 500)
            text += base[a : a + r.randrange(5, 90)] if r.random() < 0.7 else "".join(r.choice("ab") for _ in range(r.randrange(0, 60)))
        rows.append((r.choice([i, i, i, None, 5]), text if r.random() < 0.95 else None))
    return rows + rows[:3]


def brute_bytes(rows, window):
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - window + 1 if i is not None else 0):
            k = b[s : s + window]
            first[k] = min(first.get(k, i), i)
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1 if i is not None else 0):
            if first[b[s : s + window]] < i:
                gone[s : s + window] = b"\1" * window
        spans = [m.span() for m in re.finditer(b"\1+", gone)]
        out.append((str(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def deduped(frame, **more):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in suffix_dedup.dedup(frame, **more).collect())


@pytest.mark.parametrize(("seed", "window", "hot"), [(0, 50, 1 << 16), (1, 50, 2), (2, 9, 2), (3, 1, 1 << 16)])
def test_suffix_dedup(spark, monkeypatch, seed, window, hot):
    """With a small ``HOT`` most anchors are spread window by window: the results are the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = random_bytes(seed)
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("block", "bucket", "kept", "n_bytes")})
    assert deduped(frame, window=window) == brute_bytes(rows, window)


def test_suffix_dedup_of_parts_and_runs(spark, monkeypatch):
    """Suffix arrays of a few kilobytes, long runs of one character, a long text, and a passage in every document."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2000)
    r = random.Random(7)
    common = "".join(r.choice("abcdef ") for _ in range(120))
    rows = [(i, "".join(r.choice("xyzw") for _ in range(40)) + common * (i % 3) + "A" * (200 * (i % 2))) for i in range(40)]
    rows += [(100, " ".join(f"word{i % 977}" for i in range(20_000))), (101, " ".join(f"word{i % 977}" for i in range(300)))]
    assert deduped(spark.createDataFrame(rows, DOCS)) == brute_bytes(rows, 50)


def test_suffix_dedup_of_nothing(spark):
    assert deduped(spark.createDataFrame([], DOCS)) == []
    assert deduped(spark.createDataFrame([(1, None), (2, "")], DOCS)) == [("1", 0, 0, [], b""), ("2", 0, 0, [], b"")]


# --- 13 ---------------------------------------------------------------------

SPACES = "\x20\t\n\x0b\x0c\r"


def damaged_rows(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        held = by[c]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [] if kind == 0 else [(t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return by


def brute_repair(v):
    """(cost, audit, text) of the cheapest repairs' first by audit: all of them are listed, none is pruned but by its cost."""
    seen, fault = set(), []
    for _, role, text in v:
        body = text.strip(SPACES)
        fault.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def then(place, ch):
        """The place after one more initial: '', 's', 'u' (a user's turn is open) or 'ua'."""
        if not ch:
            return place
        q = place + ch
        if not re.fullmatch("s?(ua)*u?", q):
            return None
        return "ua" if re.fullmatch("s?(ua)+", q) else q if q == "s" else "u"

    def ways(i, place):
        """(edit, cost, next row, next place, line)."""
        out = [("I", 2, i, q, f"{role}:") for role in ("user", "assistant") if (q := then(place, role[0])) is not None]
        if i < len(v):
            _, role, text = v[i]
            out.append(("D", 3, i + 1, place, None))
            if fault[i] not in ("b", "d"):
                more = int(fault[i] == "t")
                if (q := then(place, role[:1])) is not None:
                    out.append(("K", more, i + 1, q, f"{role}:{text}"))
                out += [("R", 2 + more, i + 1, q, f"{name}:{text}") for name in ("user", "assistant") if (q := then(place, name[0])) is not None]
        return out

    @lru_cache(None)
    def least(i, place, inserted=0):
        over = 0 if i == len(v) and place in ("", "ua") else 10**9
        return min([over, *(cost + least(j, q, inserted + 1 if e == "I" else 0) for e, cost, j, q, _ in ways(i, place) if e != "I" or inserted < 2)])

    found = []

    def follow(i, place, left, audit, lines):
        if i == len(v) and place in ("", "ua") and not left:
            found.append((audit, lines))
            return
        for e, cost, j, q, line in ways(i, place):
            if least(j, q) <= left - cost:
                follow(j, q, left - cost, audit + e, lines if line is None else [*lines, line])

    follow(0, "", least(0, ""), "", [])
    audit, lines = min(found)
    return least(0, ""), audit, "\n".join(lines), [fault.count(x) for x in "bdt"]


def brute_repairs(rows):
    out = []
    for c, v in damaged_rows(rows).items():
        v.sort(key=lambda y: (y[0] is not None, y[0] or 0, content(y[1], y[2])))
        turns = [t for t, _, _ in v if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v[:-1], v[1:], strict=True))
        cost, audit, text, counts = brute_repair(tuple(v))
        out.append((str(c), max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, sha(text)))
    return sorted(out)


def random_conversations(seed):
    r, rows = random.Random(seed), []
    texts = ["Yes.", "ok", "Why? ", " \n", None, "é! ", "a.\x0b"]
    for c in [*range(60), None, 2**62 + 1, 2**62 + 3]:
        for t in range(r.choice([0, 1, 2, 3, 5, 8, 12, 18])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, r.choice([t, t, t, t * 2, None]), role, r.choice([*texts, f"n{t}.", f"m{t}.", f"k{t}!"])))
    return rows + rows[:5]


def repairs(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("conv", "piece", "figures", "content", "kind")})
    return sorted((str(r.conv_id), *r[1:]) for r in repair.repair(frame, repair.damaged(frame)).collect())


@pytest.mark.parametrize(("seed", "piece", "held"), [(0, 4096, 4 << 20), (1, 3, 2), (2, 1, 8)])
def test_repair(spark, monkeypatch, seed, piece, held):
    """Small pieces and a tape that spills at once give the same rows."""
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "HELD_BYTES", held)
    rows = random_conversations(seed)
    assert repairs(spark, rows) == brute_repairs(rows)


def test_repair_of_a_long_conversation(spark):
    """20,000 turns in many Arrow batches and pieces, one of them a very long text; every tenth user turn lacks its reply."""
    rows = []
    for t in range(20_000):
        if t % 2 == 0 or t % 20 != 1:
            rows.append((1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t != 7 else "long " * 100_000 + "."))
    turns = spark.createDataFrame(rows, TURNS)
    row = repair.summaries(turns).first()
    assert (row.cost, row.gaps, row.illegal, row.audit.count("I"), row.audit.count("K")) == (2000, 1000, 1000, 1000, 19_000)
    fixed = repair.repaired(turns).orderBy("pos").collect()
    assert [r.role for r in fixed] == ["user", "assistant"] * 10_000
    assert [r.pos for r in fixed] == list(range(20_000))
    assert row.repaired_sha256 == sha("\n".join(f"{r.role}:{r.text}" for r in fixed))


def test_repair_of_nothing(spark):
    assert repairs(spark, []) == []
    gone = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert repairs(spark, [(9, gone, "user", "x")]) == [("9", 0, 0, 0, 0, 0, 0, "", sha(""))]
