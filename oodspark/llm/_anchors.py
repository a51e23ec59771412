"""Winnowed anchors: places in a sequence that depend on content only.

Every window of W items has one anchor, the leftmost of its smallest hashed k-grams, so equal windows have their
anchors at equal distances.  Consecutive windows with one anchor form its context.  Two windows can be equal only if
their anchors have the same seed (the k-gram), and contexts that are equal as a whole need no look at their windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE = np.uint64(1)
BASE, OTHER, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x165667B19E3779F9)


#: Powers are kept for sequences of up to so many items.
KEPT = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        x = np.full(1 << max(12, n.bit_length()), base, dtype=np.uint64)
        x[0] = ONE
        known = np.multiply.accumulate(x)
        if n <= KEPT:
            _powers[base] = known
    return known[:n]


class Hasher:
    """Hashes of slices of one sequence of 64-bit items, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, items: np.ndarray, base: np.uint64 = OTHER):
        n = len(items)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(items * powers(int(base), n), out=self.sums[1:])
        self.back = powers(pow(int(base), -1, 1 << 64), n + 1)

    def grams(self, k: int) -> np.ndarray:
        """Of all slices of k items; the same as slices()."""
        x = (self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k]
        x ^= np.uint64(k * int(BASE) & (1 << 64) - 1)
        return x

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.back[start]
        x ^= (np.asarray(end - start)).astype(np.uint64) * BASE
        return x


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: A value is compared by its high bits, the low ones hold its place.
PLACE = 24


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each window of that width, by running minima to both ends of blocks of that width."""
    n = len(x)
    if n >> PLACE:
        return doubled(x >> np.uint64(PLACE), width)
    low = np.uint64((1 << PLACE) - 1)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    np.bitwise_or(x & ~low, np.arange(n, dtype=np.uint64), out=padded[:n])
    padded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def doubled(x: np.ndarray, width: int) -> np.ndarray:
    """The same for texts of more places than the low bits hold, by doubling."""
    at, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        span += step
    return at


def contexts(items: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """anchor, first window, last window, seed and two hashes of each context of a sequence; empty if no window fits."""
    n = len(items)
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none
    hasher = Hasher(items, BASE)
    grams = hasher.grams(k)
    at = smallest(mixed(grams), window - k + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    # the place of the anchor is part of the context: its windows are told apart by their distance to it
    lead = mixed((at[first] - first).astype(np.uint64))
    # two bases, so that contexts are told apart by 128 bits; both count the items
    whole, check = (mixed(h.slices(first, last + window) ^ lead).view(np.int64) for h in (Hasher(items), hasher))
    return at[first], first, last, grams[at[first]].view(np.int64), whole, check


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """id (never null), key (hash of the text) and text: what tells rows apart; rows equal in both have equal results."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))


ROW = "id long, key long, seed long, ctx long, chk long, at int, first int, last int, n int, gone boolean"
#: Bits of ctx; chk has 64 always.
NAME = 64
#: Rows of an Arrow batch that a task gives.
GIVEN = 1 << 17


def anchor_rows(docs: DataFrame, items, window: int, k: int, keep_first: bool) -> DataFrame:
    """A row for each context of each text of keyed(docs); items(text) gives a text's sequence.  ctx and chk tell contexts apart.

    Contexts that a batch of rows holds more than once are combined before any shuffle: one of them, with their number
    n, stands for all, and the others come out as gone, that is repeated as a whole.  The one that stands is the first in
    order of id, key and place; with keep_first, rows that are equal in id and text count as one.
    """

    drop = 64 - NAME

    def run(batches):
        source = items()
        for b in batches:
            ids, keys = (b.column(i).to_numpy() for i in (0, 1))
            order = np.lexsort((keys, ids))  # so that contexts come in order of id, key and place
            if keep_first:
                new = np.ones(len(order), dtype=bool)
                new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
                order = order[new]
            parts, texts = [], b.column(2)
            for row in order.tolist():
                found = contexts(source(texts[row].as_py()), window, k)
                if len(found[0]):
                    parts.append((row, *found))
            if not parts:
                continue
            row = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            at, first, last, seed, ctx, chk = (np.concatenate([p[i] for p in parts]) for i in range(1, 7))
            del parts
            ctx = ctx >> drop
            order = np.argsort(mixed(seed.view(np.uint64) * ODD ^ ctx.view(np.uint64)), kind="stable")
            row, at, first, last, seed, ctx, chk = (x[order] for x in (row, at, first, last, seed, ctx, chk))
            new = np.ones(len(seed), dtype=bool)
            new[1:] = (seed[1:] != seed[:-1]) | (ctx[1:] != ctx[:-1]) | (chk[1:] != chk[:-1])
            n = np.ones(len(seed), dtype=np.int32)
            n[new] = np.diff(np.append(np.flatnonzero(new), len(seed)))
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], keys[row], seed, ctx, chk, at.astype(np.int32), first.astype(np.int32), last.astype(np.int32), n, ~new)], names=["id", "key", "seed", "ctx", "chk", "at", "first", "last", "n", "gone"])
            for start in range(0, len(seed), GIVEN):
                yield out.slice(start, GIVEN)

    return docs.select("id", "key", "text").mapInArrow(run, ROW)


def unlike() -> Column:
    """Whether rows of anchor_rows() hold several contexts."""
    return (F.min("ctx") != F.max("ctx")) | (F.min("chk") != F.max("chk"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (of keyed()) with spans, an array of the (first, last) windows found in each text, empty if none."""
    per = spans.groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return docs.join(per, ["id", "key"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")))


def covered(n: int, spans, window: int) -> np.ndarray:
    """Which of n items lie in one of the windows."""
    change = np.zeros(n + 1, dtype=np.int64)
    if len(spans):
        a = np.array([(s["first"], s["last"]) for s in spans], dtype=np.int64)
        np.add.at(change, a[:, 0], 1)
        np.add.at(change, np.minimum(a[:, 1] + window, n), -1)
    return np.cumsum(change[:-1]) > 0
