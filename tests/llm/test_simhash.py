"""SimHash links and BK-trees against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from oodspark.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    """Index -> smallest index reachable."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    values = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6)))
    out = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(150)]
    long = [word() for _ in range(3000)]
    for i in range(40):  # near copies of a long text, each a word further from it
        out.append(" ".join([*long[: 40 * i], "changed", *long[40 * i + 1 :]]))
    out += [out[3].upper().replace("É", "é"), out[4] + " \n", "one", "ONE", "two words", None, "", " \t\x0b\x0c\r\n ", "\x1c\x85", "x " * 200_000]
    return out


def test_documents(spark):
    """Every row: nulls, empty and long texts, near copies in chains, repeated rows, null and repeated ids, clashing columns."""
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[0], rows[1], (7, rows[9][1]), (None, rows[2][1]), (None, "alone here and now, with no other"), (None, "alone here and now, with no other")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, id int, fp string, label int").repartition(5)
    fps = [plain_fingerprint(t) for _, t in rows]
    part = plain_components(fps, 2)
    ids = {p: [rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None] for p in part}
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(((r[0], f, min(ids[p], default=None)) for r, f, p in zip(rows, fps, part, strict=True)), key=key)
    assert len({p for p in part}) < len(set(fps))  # some links join different fingerprints
    for most in (4096, 8):  # one tree of all, and many shards
        got = [(r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.linked(df, most=most).collect()]
        assert sorted(got, key=key) == want
    assert simhash.linked(df.limit(0)).count() == 0


def points(seed, n):
    """Balls around a few centres, so close that shards of all levels are parted, and points far from all."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    near = {c ^ sum(1 << b for b in rng.sample(range(rng.choice((9, 64))), rng.randint(0, 5))) for c in centres for _ in range(n)}
    return sorted(near | {rng.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1, 1 << 63})


@pytest.mark.parametrize("radius", [0, 2])
def test_radius(spark, radius):
    """Links of every level of parting connect just what brute force connects."""
    fps = points(radius, 60)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    _, levels = simhash.routed(df, radius, 20)
    assert len(levels) >= 1 + (radius > 0)
    place = {f: i for i, f in enumerate(signed)}
    found = [(place[r["a"]], place[r["b"]]) for r in simhash.linked_points(df, radius, 20).collect()]
    label = list(range(len(fps)))
    for _ in fps:
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
    assert label == plain_components(fps, radius)


def test_search(spark):
    """Other points against a table of trees: each pair within the radius, and no other."""
    base, other = points(1, 60), points(1, 20)[:40] + points(9, 20)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = lambda fps: spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    members, levels = simhash.routed(frame(base), 2, 20)
    asked, _ = simhash.routed(frame(other), 2, 20, levels)
    got = {(r["a"], r["b"]) for r in simhash.within(asked, simhash.shard_trees(members, 3), 3).collect()}
    assert got == {(signed(a), signed(b)) for a in other for b in base if a != b and (a ^ b).bit_count() <= 2}


def test_trees():
    """Trees are those of inserting one point after the other, and keys are distances to the parent."""
    rng = random.Random(4)
    sets = [rng.sample(range(1 << 12), n) for n in (1, 150, 2, 90)]
    fps, shard = np.concatenate([np.array(x, dtype=np.uint64) for x in sets]), np.repeat(range(4), [len(x) for x in sets])
    up, edge = simhash.grown(shard, fps)
    children = {}
    for i, s in enumerate(shard):
        at = int(np.flatnonzero(shard == s)[0])
        if at == i:
            assert up[i] == -1
            continue
        while (at, d := int(fps[at] ^ fps[i]).bit_count()) in children:
            at = children[at, d]
        children[at, d] = i
        assert (up[i], edge[i]) == (at, d)
