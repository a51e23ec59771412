"""Substring dedup by seed and extend.

Documents are joined on the seeds of winnowed anchors.  The contexts of a seed that differ are joined with one of them,
the pivot, and each match with it is extended both ways, word by word, to its full length.  The windows of the matched
part are repeats.  What is left of a context lies beyond the end of its match: it goes on with the contexts that left the
pivot at the same place with the same word, that is with a seed longer by the match and that word, and a pivot of its own.
So pairs are formed with pivots only, and none is missed.  Windows that overlap join to maximal repeats, which are removed
wherever they stand.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._anchors import anchor_rows, covered, keyed, unlike, with_spans
from ._shared import WORD, dropped, stored

WINDOW, SEED = 35, 12
REMEMBERED = 250_000
#: The contexts of one seed are dealt to so many keys when they meet their pivot.
SALTS = 16
PIECE = "g long, ctx long, chk long, again boolean, id long, key long, at int, low int, high int, before string, after string"


class Words:
    """Hashes of the words of a text, or of its UTF-8 bytes, which bytes.split() parts at just the white space that counts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashed(self, word: bytes) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        h = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1
        return h

    def __call__(self, text: str | bytes) -> np.ndarray:
        get, hashed = self.known.get, self.hashed
        raw = text if isinstance(text, bytes) else text.encode("utf-8", "replace")
        return np.array([get(w) or hashed(w) for w in raw.split()], dtype=np.uint64)


def surroundings(docs: DataFrame, ctx: DataFrame, window: int) -> DataFrame:
    """ctx (id, key, first, last, at, seed, ctx, chk, again) as pieces of extended(): with the words before the anchor, the nearest
    first, and from it on; low and high are the least and most words before the anchor that a window has."""
    per = ctx.groupBy("id", "key").agg(F.collect_list(F.struct("seed", "ctx", "chk", "again", "first", "last", "at")).alias("ctxs"))

    def cut(batches):
        for b in batches:
            out = []
            for i, key, text, ctxs in zip(b["id"], b["key"], b["text"], b["ctxs"], strict=True):
                words = text.encode("utf-8", "replace").split()
                for c in ctxs:
                    at, first, last = c["at"], c["first"], c["last"]
                    before, after = b" ".join(words[first:at][::-1]), b" ".join(words[at : last + window])
                    out.append((c["seed"], c["ctx"], c["chk"], c["again"], i, key, at, at - last, at - first, before.decode("utf-8"), after.decode("utf-8")))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PIECE.split(", ")])

    return docs.join(per, ["id", "key"]).select("id", "key", "text", "ctxs").mapInPandas(cut, PIECE)


def common(a: Column, b: Column) -> Column:
    """Number of words that two arrays have in common from the start."""
    parted = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(parted > 0, parted - 1).otherwise(F.size(a)).cast("int")


def extended(pieces: DataFrame, turn: int) -> DataFrame:
    """Each piece of a group that is not its pivot, with the place of the pivot, and how many words before and from the
    anchor on the two have in common (l and s)."""
    pieces = pieces.withColumn("salt", F.pmod("ctx", F.lit(SALTS)))
    cells = pieces.groupBy("g", "salt").agg(F.min("ctx").alias("pivot"), F.count("*").alias("n"))
    pivots = cells.groupBy("g").agg(F.min("pivot").alias("ctx"), F.sum("n").alias("n")).filter("n > 1").drop("n")  # two, if both have the least ctx
    place = [F.col(c).alias(f"pivot_{c}") for c in ("id", "key", "at", "chk", "before", "after")]
    pivots = pieces.join(pivots, ["g", "ctx"]).select("g", F.col("ctx").alias("pivot"), *place)
    # a row for each cell, not each salt, so that small groups send their pivot no further than needed
    pivots = cells.select("g", "salt").join(pivots, "g")
    met = pieces.join(pivots, ["g", "salt"]).filter("ctx <> pivot OR chk <> pivot_chk")
    words = lambda c: F.array_remove(F.split(c, " "), "")
    met = met.withColumn("l", common(words("before"), words("pivot_before"))).withColumn("s", common(words("after"), words("pivot_after")))
    return stored(met.drop("salt", "pivot", "pivot_chk", "pivot_before", "pivot_after"), f"substr-met-{turn}")


def parted(met: DataFrame, window: int) -> DataFrame:
    """Pieces for the next turn: the windows that reach beyond the match on the left, and of the others those beyond it on the right.

    Two pieces with an equal window in such a part left the pivot at one place with one word, so they are in one group again.
    """
    word = lambda c, n: F.get(F.split(c, " "), F.col(n))
    left = F.struct(F.xxhash64("g", F.lit("left"), "l", word("before", "l")).alias("g"), F.greatest("low", F.col("l") + 1).alias("low"), "high")
    right = F.struct(F.xxhash64("g", F.lit("right"), "s", word("after", "s")).alias("g"), "low", F.least("high", "l", F.lit(window - 1) - F.col("s")).alias("high"))
    part = met.select("ctx", "chk", "again", "id", "key", "at", "before", "after", F.explode(F.array(left, right)).alias("part"))
    return part.select("part.*", "ctx", "chk", "again", "id", "key", "at", "before", "after").filter("low <= high")


def repeats(docs: DataFrame, window: int = WINDOW, k: int = SEED) -> DataFrame:
    """id, key, first and last: runs of windows of docs (of keyed()) whose words also start elsewhere, as numbers of first words.

    A run is found once or more often.  What stands in both of two rows that are equal in id and text is repeated, too.
    """
    rows = stored(anchor_rows(docs, Words, window, k, keep_first=False), "substr-anchors")
    span = ["id", "key", "first", "last"]
    live = rows.filter("NOT gone")
    seeds = live.groupBy("seed").agg(F.sum("n").alias("all"), unlike().alias("differ")).filter(F.col("all") > 1).select("seed", "differ")
    seeds = stored(seeds, "substr-seeds")
    shared = stored(live.join(seeds, "seed"), "substr-shared")
    dropped(seeds)
    ctx = shared.filter("differ").groupBy("seed", "ctx", "chk").agg(F.sum("n").alias("all"), F.min(F.struct(*span, "at")).alias("one"))
    ctx = stored(ctx.select("seed", "ctx", "chk", (F.col("all") > 1).alias("again"), "one.*"), "substr-contexts")
    same = shared.filter("differ").join(ctx.filter("again").select("seed", "ctx", "chk"), ["seed", "ctx", "chk"], "left_semi").select(*span)
    whole = stored(rows.filter("gone OR n > 1").select(*span).unionByName(shared.filter("NOT differ").select(*span)).unionByName(same), "substr-whole")
    dropped(rows, shared)

    # contexts that differ: one of each kind, with the words it stands in
    table = pieces = stored(surroundings(docs, ctx, window), "substr-pieces")
    dropped(ctx)
    found = []
    while not pieces.isEmpty():  # a piece's seed grows by a word at least in each turn, so there are no more than window - k
        met = extended(pieces, len(found))
        both = met.select("*", F.greatest("low", F.lit(window) - F.col("s")).alias("least"), F.least("high", "l").alias("most")).filter("least <= most")
        reach = lambda at: [(F.col(at) - F.col("most")).alias("first"), (F.col(at) - F.col("least")).alias("last")]
        pivot = both.select(F.col("pivot_id").alias("id"), F.col("pivot_key").alias("key"), *reach("pivot_at")).distinct()
        found.append(stored(both.filter("NOT again").select("id", "key", *reach("at")).unionByName(pivot), f"substr-found-{len(found)}"))
        dropped(table)
        table, pieces = met, parted(met, window)
    dropped(table)
    for runs in found:
        whole = whole.unionByName(runs)
    return whole


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept (words that stay, joined by one space) and spans of every whole text of docs (doc_id, text).

    Every place of a repeat is removed, the first included.  Null and empty texts have no words; repeated rows repeat
    each other; an empty table gives an empty result; other columns play no part.
    """
    rows = keyed(docs)

    def run(batches):
        for b in batches:
            out = []
            for i, text, spans in zip(b["id"], b["text"], b["spans"], strict=True):
                words = text.encode("utf-8", "replace").split()
                gone = covered(len(words), spans, window)
                out.append((i, len(words), int(gone.sum()), b" ".join(itertools.compress(words, (~gone).tolist())).decode("utf-8")))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    return with_spans(rows, repeats(rows, window)).select("id", "text", "spans").mapInPandas(run, "id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir):
    kept = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    doc_id = F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id")
    return kept.select(doc_id, "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: Whole tables by SQL: each window of 35 words as text.  Right at small sizes only.
ORACLE = f"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
s AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS c FROM s) WHERE c > 1),
g AS (SELECT DISTINCT rid, i + k AS j FROM r, (SELECT unnest(range(35)) AS k)),
x AS (SELECT rid, list(j) AS js FROM g GROUP BY 1),
k AS (SELECT doc_id, ws, coalesce(js, []) AS js FROM w LEFT JOIN x USING (rid)),
b AS (SELECT doc_id, ws, js, list_transform(list_distinct(js), lambda j: j) AS gone FROM k),
o AS (SELECT doc_id, ws, gone, map_from_entries(list_transform(gone, lambda j: struct_pack(k := j, v := true))) AS m FROM b)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(list_filter(ws, lambda w, j: m[j] IS NULL), ' ')) AS kept_sha256 FROM o"""

QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES = {"op9_substring_dedup": ORACLE}
