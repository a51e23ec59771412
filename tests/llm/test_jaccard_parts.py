"""The n-gram join's count sketch, its bands of sizes, and what it leaves in the shared folder."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import near_duplicates

from oodspark.llm import jaccard
from oodspark.llm._anchors import keyed


def varied(count, seed):
    """Texts of 3 to 400 words that start alike and go on in a few ways, so that sizes alone tell most pairs apart."""
    rng = random.Random(seed)
    ways = [[f"w{i}" if i < 6 else f"v{way}-{i}" for i in range(400)] for way in range(3)]
    rows = []
    for i in range(count):
        w = list(rng.choice(ways)[: int(3 * 133 ** rng.random())])
        if len(w) > 20 and rng.random() < 0.5:
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("bits", [14, 19, 20])
def test_sketch(spark, bits):
    """The chunks of many tasks add up to the count of every token's slot."""
    rows = [*varied(60, 1), (None, None), (3, ""), (3, "")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    made = jaccard.described(docs, 3, bits)
    sketches = made.filter("chunk IS NOT NULL").select("chunk", "counts")
    grams = jaccard.Grams(3)
    slots = np.concatenate([grams(t) for _, t in rows]) >> np.uint64(64 - bits)
    assert sketches.groupBy("chunk").count().agg(F.max("count")).first()[0] > 1
    assert (jaccard.summed(sketches, bits) == np.bincount(slots.astype(np.int64), minlength=1 << bits)).all()
    assert made.filter("chunk IS NULL").count() == len(rows)
    assert (jaccard.summed(sketches.limit(0), bits) == 0).all()


def test_large_counts():
    counts = np.array([0, 1, 255, 256, 2**31 - 1, 2**31, 2**40])
    assert jaccard.unpacked(jaccard.packed(counts)).tolist() == [0, 1, 255, 256, 2**31 - 1, 2**31 - 1, 2**31 - 1]


@pytest.mark.parametrize(("similar", "of"), [(90, 100), (80, 100), (1, 3), (100, 100)])
def test_bands(spark, similar, of):
    """Two sizes that may be linked share a band, in whichever order; most others don't."""
    sizes = [1, 2, 3, 4, 5, 8, 9, 10, 16, 20, 45, 50, 80, 90, 100, 729, 810, 900, 1000, 10**6, 8 * 10**5, 9 * 10**5]
    rows = jaccard.banded(spark.createDataFrame([("k", n) for n in sizes], "key string, n int"), "key", F.col("n"), similar, of)
    bands = {}
    for r in rows.collect():
        bands.setdefault(r["n"], set()).add(r["band"])
    assert all(len(b) <= 2 for b in bands.values())
    for n in sizes:
        for m in sizes:
            if n * of >= m * similar and m * of >= n * similar:
                assert bands[n] & bands[m], (n, m)
    assert not bands[1] & bands[10**6]


@pytest.mark.parametrize(("wide", "block"), [(24, 512), (1, 4)])
def test_sizes_apart(spark, wide, block, monkeypatch):
    """Long token lists and clusters of sets of all sizes, in bands and small blocks."""
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
    rows = varied(150, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(df).collect()}
    assert got == near_duplicates(rows, 3, 90)
    left = [p.name for p in set(folder.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("oodspark-jaccard-labelled")


@pytest.mark.parametrize("bits", [1, 5])
def test_names_in_common(spark, bits, monkeypatch):
    """Unlike sets of one hash go by their second one."""
    monkeypatch.setattr(jaccard, "NAME", bits)
    rows = [*varied(80, 3), (80, ""), (81, None), (82, "w0 w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = jaccard.described(keyed(df), 3, 19).filter("id IS NOT NULL")
    assert 0 < len(jaccard.ambiguous(told)) <= 1 << bits
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(df).collect()}
    assert got == near_duplicates(rows, 3, 90)


def test_names_of_their_own(spark):
    docs = keyed(spark.createDataFrame([*varied(80, 3), *[(100 + i, t) for i, t in varied(80, 3)]], "doc_id long, text string"))
    assert jaccard.ambiguous(jaccard.described(docs, 3, 19).filter("id IS NOT NULL")) == frozenset()
