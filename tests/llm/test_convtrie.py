"""The conversation trie against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from nightloom.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, slot string, least string, words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = tuple(own.get(first, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, saved + sum(sums[k][1] for k in kids[p]))
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), *sums[p], digest(p)) for p, m in members.items()), key=str)


def _check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "x", "x", 7) for r in rows], SCHEMA).repartition(5)
    found = convtrie.conversation_trie(docs)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == _brute(rows)


@pytest.fixture
def small_parts(monkeypatch):
    """Blocks, stretches, local tables and merges so small that all their borders are met."""
    for name, value in (("STRETCH_BITS", 1), ("BLOCK_BITS", 1), ("LOCAL_ROWS", 7), ("MERGES", (3, 2, 1))):
        monkeypatch.setattr(convtrie, name, value)


ODD = (
    [(c, t, "user" if t % 2 == 0 else "assistant", f"hello {t} {c % 3 if t > 1 else ''}") for c in range(45) for t in range(c % 6 + 1)]
    + [(c, t, "user", "the very same turns") for c in range(60, 90) for t in range(5)]
    + [(100, None, None, None), (100, 3, "a", "x"), (100, 3, "a", "x"), (100, 3, None, "b"), (100, None, "z", " "), (101, None, None, ""), (117, 0, "", None)]
    + [(None, 1, "user", "no conversation"), (-5, 0, "user", "below zero"), (-20, -9000, "user", "hello 0 "), (-20, 9000, "user", "word " * 3000), (1 << 40, 0, "user", "hello 0 ")]
)


def test_odd_rows(spark):
    _check(spark, ODD)


def test_small_parts(spark, small_parts):
    _check(spark, ODD)


def test_a_long_conversation_and_many_equal_ones(spark, small_parts):
    _check(spark, [(1, t, "user", f"turn {t % 5}") for t in range(150)] + [(c, t, "user", f"turn {t % 5}") for c in range(2, 50) for t in range(3)])


def test_no_conversations(spark):
    assert convtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
