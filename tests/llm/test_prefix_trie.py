"""The prefix trie against a plain one, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, n int, c string, depth long, words int"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain(rows, group=20, most=4):
    """rows: (conv_id, turn, role, text) -> {(depth, conv_id): the other columns}"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = abs(c) - abs(c) % group
        built[c] = own.get(base if c >= 0 else -base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def sums(p):
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = int(not kids[p]), (len(nodes[p]) - 1) * words
        for k in kids[p]:
            a, b = sums(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = {}
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out[len(p), min(members)] = (min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), *sums(p), hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(spark, rows, parts=3):
    from tidemark.llm.prefix_trie import prefix_trie

    df = spark.createDataFrame([(*r, 7, "x", 8, 9) for r in rows], SCHEMA).repartition(parts)
    got = prefix_trie(df).collect()
    out = {(r["depth"], r["conv_id"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 90), *range(-45, 0, 3), 10**12]:
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello there", "a b\tc", "", "yes"])))
    assert found(spark, rows) == plain(rows)


def test_nulls_ties_repeats_long(spark):
    rows = [(None, 0, "user", "no conversation"), (5, None, None, None), (5, None, "a", "z"), (5, 1, "a", "tie b"), (5, 1, "a", "tie a"), (5, 1, "a", "tie a"), (6, 0, "", ""), (7, 0, None, None), (7, 10**15, "x", "w " * 50_000), (7, -(10**15), "x", "first"), (20, 0, "u", "only one"), (21, 0, "q", "r")]
    rows += [(c, t, "user", f"turn {t}") for c in (40, 41, 42) for t in range(3)]
    assert found(spark, rows) == plain(rows)


def test_prefix_and_digits_do_not_run_together(spark):
    """Role and text are told apart, and so are nodes of the same member at other depths."""
    rows = [(100, 0, "ab", "c"), (120, 0, "a", "bc"), (140, 0, "", "abc"), (160, 0, "1", ":x")]
    got = found(spark, rows)
    assert got == plain(rows) and got[0, 100][2] == 4


def test_many_copies_of_one_conversation(spark, monkeypatch):
    """A third of all conversations are equal; their ids are joined from many short texts."""
    from tidemark.llm import prefix_trie as module

    monkeypatch.setattr(module, "LETTERS", 40)
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)] + [(20 * c, 0, "user", f"own {c}") for c in range(400, 900)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert got[3, 0][4] == 399 * 2 and got[0, 0][1] == 900


def test_long_conversation_in_stretches(spark, monkeypatch):
    from tidemark.llm import prefix_trie as module

    monkeypatch.setattr(module, "STRETCH", 10)
    rows = [(60, t, "u", f"t{t}") for t in range(60)] + [(80, t * 7, "u", f"t{t}") for t in range(12)]
    assert found(spark, rows) == plain(rows)


def test_turnless_and_empty(spark):
    rows = [(11, 0, "u", "x")]  # its first turns come from conversation 0, which isn't there
    h = zlib.crc32(b"11") % 4
    got = found(spark, rows)
    assert got == plain(rows) and (h == 0 or got == {(0, 11): (None, 1, 0, 1, 0, hashlib.sha256(b"11").hexdigest())})
    assert found(spark, []) == {}


@pytest.mark.parametrize("copies", [2, 30])
def test_deep_shared_conversations(spark, copies):
    rows = [(20 * c, t, "u", f"t{t} word") for c in range(copies) for t in range(9)]
    got = found(spark, rows)
    assert got == plain(rows) and got[9, 0][5] != EMPTY
