"""The prefix trie against a plain version, on conversations that hold what is odd."""

import collections
import hashlib
import random
import zlib

import pytest

from oodspark.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, parent int, saved double"


def conversations(seed=3):
    """Shared beginnings, null and repeated turns, ties, a long chain that two share, absent bases, negative and null ids."""
    rng = random.Random(seed)
    texts = ["", "a", "bé", "ccc", "ends here", None]
    rows = [(c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for c in [*range(95, 130), *range(200, 215), *range(-120, -90), 5, 1007, 1013] for t in range(rng.randint(1, 7))]
    rows += [(7, t, "user", f"turn {t % 50}") for t in range(230)] + [(8, t, "user", f"turn {t % 50}" if t < 180 else "other") for t in range(230)]
    rows += [(300, None, "x", "first"), (300, None, "x", "first"), (300, None, "w", "tie"), (300, 4, None, None), (300, 4, "x", None), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(301 + i, 0, "user", "the same") for i in range(70)] + [(400, 0, "long", "é" * 50_000), (401, 0, "long", "é" * 50_000)]
    rows += [rows[3], rows[10]]
    rng.shuffle(rows)
    return rows


def plain(rows, every=100, shared=6):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    base = lambda c: c - (abs(c) % every) * (1 if c >= 0 else -1)
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % shared
        full[c] = tuple(own.get(base(c), [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(full[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2, 0.5) for r in rows], SCHEMA).repartition(7)
    return sorted(tuple(r) for r in tries.prefix_trie(df, **how).collect())


@pytest.mark.parametrize("stretch", [16])
def test_trie(spark, monkeypatch, stretch):
    """Long chains and conversations in many stretches, and ids in many runs (the other tests have one)."""
    monkeypatch.setattr(tries, "STRETCH", stretch)
    monkeypatch.setattr(tries, "RUN", stretch // 4)
    rows = conversations()
    assert trie(spark, rows) == plain(rows)


def test_other_parameters(spark):
    rows = conversations(8)
    assert trie(spark, rows, every=10, shared=3) == plain(rows, 10, 3)


def test_small_tries(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "a", "b")]) == []
    gone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)  # its base is absent, and its one turn is not kept
    rows = [(gone, 0, "user", "lost")]
    assert trie(spark, rows) == plain(rows) and len(plain(rows)) == 1
    rows = [(0, t, "user", None) for t in range(40)]
    assert trie(spark, rows) == plain(rows) and len(plain(rows)) == 41


def test_subtree_totals_of_any_tree(spark):
    """Random trees, a comb (chains that fork one leaf at a time) and a star."""
    rng = random.Random(2)
    for up in ([None] + [rng.randrange(i) for i in range(1, 150)], [None] + [rng.randrange(max(0, i - 2), i) for i in range(1, 100)], [None] + [i - 1 - (i % 2 == 0) * (i > 1) for i in range(1, 40)], [None] + [0] * 150):
        n = len(up)
        kids = collections.Counter(p for p in up if p is not None)
        own = [(rng.randrange(9), int(not kids[i])) for i in range(n)]
        total = [list(x) for x in own]
        for i in range(n - 1, 0, -1):
            total[up[i]][0] += total[i][0]
            total[up[i]][1] += total[i][1]
        name = lambda i: None if i is None else bytes([i // 256, i % 256])
        df = spark.createDataFrame([(name(i), name(up[i]), *own[i], kids[i]) for i in range(n)], "node binary, parent binary, saved long, leaves long, kids long")
        got = {bytes(r["node"]): [r["saved"], r["leaves"]] for r in tries.subtree_totals(df).collect()}
        assert got == {name(i): total[i] for i in range(n)}
