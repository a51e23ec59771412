"""Suffix-array dedup: every byte of a long string that also starts earlier is removed.

Anchors bring together the places where equal strings can stand.  Contexts that are copies of each other are combined
before they are moved on: the first of them stands for all.  The texts around an anchor that differ are then sorted by
suffix arrays, one that reads from the anchor on and one that reads back from it, and the common prefixes of neighbours
in both orders tell which windows are equal.

The suffix array is built by linear grouping: suffixes are grouped by Lyndon prefix from the highest group down, each
group extending the groups that its previous-smaller pointers reach; then one pass over the array emits the order inside
the groups.  Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import anchor_rows, covered, keyed, mixed, text_key, unlike, with_spans
from ._shared import dropped, stored

WINDOW, SEED = 100, 24
#: Strings in a suffix array at most around one anchor, and in all.  Around an anchor with more of them, windows are dealt to
#: narrower anchors of so many windows each, and so on down to one.
STRINGS, NARROWER = 8192, (16, 4, 1)
#: Bytes in a symbol of the suffix arrays.
SYMBOL = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    symbols, group = np.unique(text, return_inverse=True)
    group = (group + 1).tolist()
    members: list = [[] for _ in range(len(symbols) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), 0]
    done, before = bytearray(n), [0] * n
    g = len(members) - 1
    while g > 0:  # the groups from the highest down; group 0 is that of no suffix
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            done[i] = 1
        reached: dict[int, int] = {}
        for i in own:  # ascending; the nearest earlier suffix of a lower group
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        members[g] = own
        if reached:
            split: dict[tuple[int, int], list[int]] = {}
            for p in sorted(reached) if len(reached) > 1 else reached:
                split.setdefault((group[p], reached[p]), []).append(p)
            for (old, _), moved in sorted(split.items(), reverse=True, key=lambda x: x[0]) if len(split) > 1 else split.items():
                new, up = len(members), above[old]  # right above old: those reached more often were put in before and stand higher
                members.append(moved)
                below.append(old)
                above.append(up)
                above[old] = new
                if up:
                    below[up] = new
                for p in moved:
                    group[p] = new
        g = below[g]
    # first place of each group, from the lowest up
    free, place, g = [0] * len(members), 0, above[0]
    while g:
        free[g] = place
        place += len(members[g])
        g = above[g]
    order, placed = [-1] * n, bytearray(n)
    s = n - 1  # the end of the text stands before all
    for k in range(-1, n):
        s = n - 1 if k < 0 else order[k] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            placed[s] = 1
            free[g] += 1
            s = before[s]
    return np.array(order, dtype=np.int64)


class Bytes:
    """A 64-bit item for each byte of a text."""

    def __init__(self):
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        return self.table.take(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8))


def matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each part as a row, filled up with zeros to whole symbols, and the lengths."""
    lens = np.array([len(x) for x in parts], dtype=np.int64)
    width = max(1, -(-int(lens.max()) // SYMBOL)) * SYMBOL
    return np.frombuffer(b"".join([x.ljust(width, b"\0") for x in parts]), dtype=np.uint8).reshape(len(parts), width), lens


def neighbours(order: np.ndarray, rows: np.ndarray, lens: np.ndarray, core: np.ndarray) -> np.ndarray:
    """How many first bytes each row shares with the one before it in the order; -1 if they have other anchors."""
    a, b = order[:-1], order[1:]
    differ = rows[a] != rows[b]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    same = np.minimum(same, np.minimum(lens[a], lens[b]))
    return np.concatenate([[-1], np.where(core[a] == core[b], same, -1)])


def sorted_around(core: np.ndarray, left: list[bytes], right: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Order and neighbours() of strings by what is right of their anchor, and by what is left of it read backwards.

    Both orders come from one suffix array: its text has each side of each string, led by a symbol of the anchor and the
    side, and closed by the smallest symbol.
    """
    sides = [matrix(right), matrix([x[::-1] for x in left])]
    words = np.concatenate([m.reshape(-1, SYMBOL).view(">u8") for m, _ in sides]).astype(np.uint64)
    high, low = (np.unique(words[:, i], return_inverse=True)[1] for i in (0, 1))  # in order of the bytes
    _, rank = np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)
    _, anchor = np.unique(core, return_inverse=True)
    n, kinds, at, texts, starts = len(core), int(anchor.max()) + 1, 0, [], []
    for side, (m, lens) in enumerate(sides):
        wide, many = m.shape[1] // SYMBOL, -(-lens // SYMBOL)
        rows = np.zeros((n, wide + 2), dtype=np.int64)
        rows[:, 0] = 1 + anchor + side * kinds
        rows[:, 1:-1] = 1 + 2 * kinds + rank[at : at + n * wide].reshape(n, wide)
        rows[np.arange(n), many + 1] = 0
        texts.append(rows[np.arange(wide + 2) <= many[:, None] + 1])
        starts.append(np.concatenate([[0], np.cumsum(many + 2)[:-1]]))
        at += n * wide
    text = np.concatenate(texts)
    string = np.full(len(text), -1)
    string[starts[0]] = np.arange(n)
    string[starts[1] + len(texts[0])] = np.arange(n, 2 * n)
    order = string[suffix_array(text)]
    orders = order[(order >= 0) & (order < n)], order[order >= n] - n
    return [(o, neighbours(o, m, lens, core)) for o, (m, lens) in zip(orders, sides, strict=True)]


def again(core: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, text: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """string, first and last of runs of windows that equal one of an earlier string with the same anchor.

    Strings come in order of their place.  text is what their windows first to last cover; the anchor stands at "at".
    """
    low, high = first - at, last - at
    cut = (-low).tolist()
    (by_right, right), (by_left, left) = sorted_around(core, [t[:c] for t, c in zip(text, cut, strict=True)], [t[c:] for t, c in zip(text, cut, strict=True)])
    n, least = len(core), int(low.min())
    found = np.zeros((n, int(high.max()) - least + 2), dtype=bool)
    l, r = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(least, int(high.max()) + 1):  # windows at one distance from their anchors: equal on both sides, or not
        here = np.flatnonzero((low <= d) & (d <= high))
        l[by_left], r[by_right] = np.cumsum(left < -d), np.cumsum(right < window + d)
        _, heads = np.unique(l[here] * n + r[here], return_index=True)
        later = np.ones(len(here), dtype=bool)
        later[heads] = False
        found[here[later], d - least] = True
    edge = np.diff(np.concatenate([np.zeros((n, 1), dtype=np.int8), found.view(np.int8)], axis=1), axis=1)
    string, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return string, at[string] + least + begin, at[string] + least + end - 1


STRING = "core long, id long, key long, at int, first int, last int, text binary"
SPAN = "id long, key long, first int, last int"


def strings(docs: DataFrame, ctx: DataFrame, window: int) -> DataFrame:
    """The text of each context of ctx (seed, id, key, at, first, last), cut from docs."""
    per = ctx.groupBy("id", "key").agg(F.collect_list(F.struct("seed", "at", "first", "last")).alias("ctxs"))

    def cut(batches):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                lists = part.column(3)
                flat, each = lists.flatten(), np.diff(lists.offsets.to_numpy())
                seed, at, first, last = (x.to_numpy() for x in flat.flatten())
                row = np.repeat(np.arange(part.num_rows), each)
                raw = [t.encode("utf-8", "replace") for t in part.column(2).to_pylist()]
                text = [raw[r][a:z] for r, a, z in zip(row.tolist(), first.tolist(), (last + window).tolist(), strict=True)]
                ids, keys = (part.column(i).to_numpy()[row] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seed, ids, keys, at, first, last)] + [pa.array(text, pa.binary())], names=["core", "id", "key", "at", "first", "last", "text"])

    return docs.join(per, ["id", "key"]).select("id", "key", "text", "ctxs").mapInArrow(cut, STRING)


def arrays(found: DataFrame, window: int, lots: int) -> DataFrame:
    """Spans of the windows of strings that equal one of an earlier string with the same core."""

    def sort(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["core", "id", "key", "at"]).sort_values(["id", "key", "at"], kind="stable")  # rows may repeat each other
        core, at, first, last = (f[c].to_numpy().astype(np.int64) for c in ("core", "at", "first", "last"))
        string, begin, end = again(core, at, first, last, f["text"].tolist(), window)
        return pd.DataFrame({"id": f["id"].to_numpy()[string], "key": f["key"].to_numpy()[string], "first": begin.astype(np.int32), "last": end.astype(np.int32)})

    return found.groupBy(F.pmod(F.xxhash64("core"), F.lit(lots)).alias("lot")).applyInPandas(sort, SPAN)


def narrowed(found: DataFrame, window: int, width: int) -> DataFrame:
    """Strings dealt to anchors of at most so many windows: the bytes that all windows of such a block share are its core."""
    blocks = F.sequence(F.expr(f"(at - last) div {width}"), F.expr(f"(at - first) div {width}"))
    rows = found.withColumn("b", F.explode(blocks)).withColumn("begin", F.expr(f"at - CAST(b AS INT) * {width}"))
    rows = rows.withColumn("low", F.expr(f"greatest(first, begin - {width - 1})")).withColumn("high", F.least("last", "begin"))
    core = F.xxhash64("core", "b", F.expr(f"substring(text, begin - first + 1, {window - width + 1})"))
    part = F.expr(f"substring(text, low - first + 1, high - low + {window})")
    return rows.select(core.alias("core"), "id", "key", F.col("begin").alias("at"), F.col("low").alias("first"), F.col("high").alias("last"), part.alias("text"))


def earlier(docs: DataFrame, window: int = WINDOW, k: int = SEED) -> DataFrame:
    """id, key, first and last: runs of windows of docs (of keyed()) whose bytes also start earlier, as byte offsets."""
    span, place = ["id", "key", "first", "last"], ["id", "key", "at"]
    rows = stored(anchor_rows(docs, Bytes, window, k, keep_first=True), "suffix-anchors")
    live = rows.filter("NOT gone")
    seeds = stored(live.groupBy("seed").agg(F.count("*").alias("all"), unlike().alias("differ")).filter("all > 1").select("seed", "differ"), "suffix-seeds")
    shared = stored(live.join(seeds, "seed").select("seed", "ctx", "chk", "differ", *place, "first", "last"), "suffix-shared")
    gone = stored(rows.filter("gone").select(*span), "suffix-gone")
    dropped(rows, seeds)
    ctx = stored(shared.groupBy("seed", "ctx", "chk", "differ").agg(F.min(F.struct(*place, "first", "last")).alias("one")), "suffix-contexts")
    later = shared.join(ctx.select("seed", "ctx", "chk", "one"), ["seed", "ctx", "chk"]).filter(F.struct(*place) != F.struct("one.id", "one.key", "one.at")).select(*span)
    spans = [stored(gone.unionByName(later), "suffix-whole")]
    dropped(shared, gone)

    differ = ctx.filter("differ").select("seed", "one.*")
    found = stored(strings(docs, differ, window), "suffix-strings")
    hot = stored(differ.groupBy(F.col("seed").alias("core")).count().filter(F.col("count") > STRINGS).select("core"), "suffix-hot")
    lots = lambda n: max(1, -(-n // STRINGS))
    spans.append(stored(arrays(found.join(hot, "core", "left_anti"), window, lots(differ.count())), "suffix-again"))
    dropped(ctx)
    for width in NARROWER:
        if hot.isEmpty():
            break
        cut = stored(narrowed(found.join(hot, "core", "left_semi"), window, width), f"suffix-cut-{width}")
        same = ["core", F.expr("at - first").alias("lead"), "text"]
        ones = stored(cut.groupBy(*same).agg(F.min(F.struct(*place, "first", "last")).alias("one")), f"suffix-ones-{width}")
        met = cut.withColumn("lead", F.expr("at - first")).join(ones, ["core", "lead", "text"])
        spans.append(stored(met.filter(F.struct(*place) != F.struct("one.id", "one.key", "one.at")).select(*span), f"suffix-same-{width}"))
        dropped(found, hot, cut)
        found = ones.select("core", "one.*", "text")
        counts = stored(found.groupBy("core").count().filter("count > 1"), f"suffix-counts-{width}")
        hot = stored(counts.filter(F.col("count") > STRINGS).select("core"), f"suffix-hot-{width}")
        few = found.join(counts.filter(F.col("count") <= STRINGS).select("core"), "core", "left_semi")
        spans.append(stored(arrays(few, window, lots(found.count())), f"suffix-again-{width}"))
        dropped(counts)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def without_earlier(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, key, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of every whole text of docs.

    A null text is empty.  Matches never cross documents; strings are judged on the input.  Rows that repeat both id and
    text count as one document and get one result each; rows of one id with other texts stand in order of their hash.
    An empty table gives an empty result; other columns play no part.
    """
    rows = keyed(docs)
    return with_spans(rows, earlier(rows, window)).withColumn("_cut", cutter(window)("text", "spans")).select("id", "key", "_cut.*")


def cutter(window: int, kept: str = "binary"):
    """What a text loses, and its kept bytes, or with kept="string" its kept whole characters."""

    @F.pandas_udf(f"n_bytes long, n_removed long, n_spans long, kept {kept}")
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, spans, strict=True):
            raw = np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)
            gone = covered(len(raw), s, window)
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(raw), int(gone.sum()), runs, raw[~gone].tobytes() if kept == "binary" else raw[~gone].tobytes().decode("utf-8", "ignore")))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def shortened(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with what stands earlier removed from text, and n_chars to match; other columns unchanged.

    Of a character that a removed run cuts in two, nothing stays.  No row goes.
    """
    rows = keyed(docs)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    cut = with_spans(whole, earlier(rows, window)).withColumn("_kept", cutter(window, "string")("text", "spans")["kept"])
    cut = cut.withColumn("_text", F.when(F.col("_doc.text").isNotNull(), F.col("_kept")))
    columns = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"_doc.{c}").alias(c) for c in docs.columns]
    return cut.select(*columns)


def op2_suffix_dedup(spark, sf_dir):
    kept = without_earlier(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    doc_id = F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id")
    return kept.select(doc_id, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
