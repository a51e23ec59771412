"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word n-grams.  Equal sets are one class from the start.  Tokens of a set are put in order of a
count sketch, rare first; two sets over the threshold must share l of the first n - least overlap + l tokens, for every
l.  Each set chooses its own l: a longer prefix costs more entries in the token lists, but candidates must share more of
it.  Tokens in few sets give candidate pairs by join; sets that meet in the list of a token in very many sets are put
compared list by list, in blocks.  Of either kind only pairs stay whose parity sketches differ in no more bits than the
threshold lets the sets differ in tokens, which no linked pair fails.  What is left decides which sets are looked at
together.  Within these clusters links are verified exactly, as many as connect all that is linked.

Large lists and clusters are mostly groups of copies, so all their sets are first held against a few pivots, one row for
each set and pivot.  Only what no pivot connects is then met with the others, block by block, and of these only with sets of about its own size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import keyed, mixed, text_key
from ._shared import released, stored, tidy
from .components import components
from .substrings import Words

#: Words in an n-gram, and least similarity as a ratio of whole numbers.
GRAM, SIMILAR, OF = 3, 90, 100
#: Bits of the count sketch, at least and at most: a slot for each row between these, so 64 MB at most.
SKETCH_BITS = (19, 24)
#: Slots of the sketch that are kept and added up together.
CHUNK = 1 << 14
#: Most tokens a pair may be asked to share, and the cost of a verification, for each token, against that of a list entry.
LONGEST, VERIFY = 6, 0.1
#: A token in more sets has its list taken as a whole.
WIDE = 24
#: Sets in a verified block, and in a block of a list.  Pivots that a large cluster's sets are held against.
BLOCK, LIST_BLOCK, PIVOTS = 512, 1024, 3
#: Rows of one component are dealt to so many keys when they learn its smallest id.
SALTS = 32
#: Width of a band of sizes, in steps by which the sizes of linked sets may differ.
BAND = 4
#: Bits of the hash that names a set.
NAME = 64
#: Words of 64 bits in a parity sketch: each token flips one bit.
PARITY = 16
BITS = [f"p{i}" for i in range(PARITY)]
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Grams:
    """Sorted distinct hashes of the n-grams of a text, A-Z in lower case; a text of fewer words is one n-gram, one without words none."""

    def __init__(self, gram: int):
        self.words, self.gram = Words(), gram

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words((text or "").encode("utf-8", "replace").lower())  # of bytes, that is A-Z only
        if not len(h):
            return h
        width = min(self.gram, len(h))
        x = h[: len(h) - width + 1].copy()
        for i in range(1, width):
            x = x * ONE + h[i : len(h) - width + 1 + i]
        return np.unique(mixed(x * TWO + np.uint64(width)))


def signature(s: np.ndarray, bits: int) -> int:
    """Hash of a set, of so many bits."""
    x = mixed(s * TWO).sum(dtype=np.uint64) ^ np.uint64(len(s))
    return int((x >> np.uint64(64 - bits)).view(np.int64))


def other(s: np.ndarray) -> int:
    """A second hash of a set, drawn apart from the first."""
    x = mixed(mixed(s ^ TWO) * ONE).sum(dtype=np.uint64)
    return int((x + np.uint64(len(s)) * TWO).view(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """Which bits an odd number of tokens fall on: two sets differ in at least as many tokens as their sketches in bits."""
    odd = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketch_bits(rows: int) -> int:
    return min(max(rows.bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def described(docs: DataFrame, gram: int, slots_bits: int) -> DataFrame:
    """id, key, n (size of the set), sig, other and parity sketch p0, p1 ... of each row of keyed(docs); and with null id, a task's count sketch of the tokens: a row (chunk, counts) for each chunk of slots that it counted anything in."""

    name = NAME

    def run(batches):
        grams, sketch = Grams(gram), np.zeros(1 << slots_bits, dtype=np.int32)
        for b in batches:
            n, sig, second, odd = [], [], [], [np.zeros((0, PARITY), dtype=np.int64)]
            for t in b["text"]:
                s = grams(t)
                n.append(len(s))
                sig.append(signature(s, name))
                second.append(other(s))
                odd.append(parity(s)[None])
                np.add.at(sketch, (s >> np.uint64(64 - slots_bits)).astype(np.int64), 1)
            bits = np.concatenate(odd)
            yield pd.DataFrame({"id": b["id"], "key": b["key"], "n": n, "sig": sig, "other": second, "chunk": None, "counts": None} | {p: bits[:, i] for i, p in enumerate(BITS)})
        chunks = sketch.reshape(-1, CHUNK)
        seen = np.flatnonzero(chunks.any(axis=1))
        yield pd.DataFrame({"id": None, "key": 0, "n": 0, "sig": 0, "other": 0, "chunk": seen, "counts": [packed(chunks[c]) for c in seen]} | dict.fromkeys(BITS, 0), index=range(len(seen)))

    return docs.mapInPandas(run, "id long, key long, n int, sig long, other long, chunk int, counts binary, " + ", ".join(f"{p} long" for p in BITS))


def packed(counts: np.ndarray) -> bytes:
    """Counts as bytes; most are small, so few bits are left of each."""
    return zlib.compress(np.minimum(counts, 2**31 - 1).astype("<i4").tobytes(), 1)


def unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), dtype="<i4")


def summed(sketches: DataFrame, slots_bits: int) -> np.ndarray:
    """The count sketch of all tasks, from their rows (chunk, counts).

    The rows of a chunk go to one task, which adds them up one by one and holds nothing but the sums.  The driver gets one
    row for each chunk, 2 ** slots_bits counts in all, and lays them side by side.
    """

    def add(batches):
        totals = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                totals[chunk] = totals.get(chunk, 0) + unpacked(counts.as_py()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([packed(t) for t in totals.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((-(-(1 << slots_bits) // CHUNK), CHUNK), dtype=np.int32)
    for r in sketches.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():  # a row for each chunk
        out[r["chunk"]] = unpacked(r["counts"])
    return out.reshape(-1)


def ambiguous(told: DataFrame) -> frozenset[int]:
    """Values of sig that unlike sets of told have in common: of m different sets about m * m / 2 ** 65, three among 10 ** 10."""
    unlike = F.greatest(*[(F.min(c) != F.max(c)).cast("int") for c in ("other", "n")])
    return frozenset(r["sig"] for r in told.groupBy("sig").agg(unlike.alias("unlike")).filter("unlike = 1").select("sig").collect())


def prefixes(docs: DataFrame, gram: int, similar: int, of: int, sketch, rows: int, unsure: frozenset[int]) -> DataFrame:
    """token, sig, n, l (tokens the set asks for) and level (the least l whose prefix has the token) of each prefix token.

    Asking for l tokens costs the entries of the lists read, and a verification for each of the sets that share l tokens
    by chance: with lists of L entries over all, about rows * (L / rows) ** l / l!.  A batch gives the rows of equal sets
    once.  Sets whose sig is one of unsure go by their second hash.
    """
    name = NAME

    def run(batches):
        grams, counts = Grams(gram), sketch.value
        noise, shift = counts.mean(), np.uint64(65 - len(counts).bit_length())
        for b in batches:
            parts, seen = [], set()
            for t in b["text"]:
                s = grams(t)
                n = len(s)
                sig = signature(s, name)
                if sig in unsure:
                    sig = other(s)
                if not n or (sig, n) in seen:
                    continue
                seen.add((sig, n))
                df = counts[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, df))
                free = n - -(-similar * n // of)
                most = min(LONGEST, n - free)
                near = np.maximum(df[order[: free + most]] - noise, 1.0)
                entries, ls = np.cumsum(near)[free:], np.arange(1, most + 1)
                chance = np.cumsum(np.log(np.maximum(entries / max(rows, 1), 1e-12)[:, None] / ls[None, :]), axis=1).diagonal()
                l = int(np.argmin(entries + VERIFY * n * rows * np.exp(chance))) + 1
                parts.append((s[order[: free + l]].view(np.int64), sig, n, l, np.maximum(np.arange(free + l) - free + 1, 1)))
            if parts:
                each = [len(p[0]) for p in parts]
                yield pd.DataFrame({"token": np.concatenate([p[0] for p in parts]), "sig": np.repeat([p[1] for p in parts], each), "n": np.repeat([p[2] for p in parts], each), "l": np.repeat([p[3] for p in parts], each), "level": np.concatenate([p[4] for p in parts])})

    return docs.mapInPandas(run, "token long, sig long, n int, l int, level int")


def looked_at(lists: DataFrame, similar: int, of: int) -> DataFrame:
    """a and b: sets to be looked at together.  lists are the prefix rows of tokens in several sets, with df, their number, and parity sketches."""
    few, many = lists.filter(F.col("df") <= WIDE), lists.filter(F.col("df") > WIDE)
    x = few.select("token", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("l").alias("la"), F.col("level").alias("va"), *[F.col(p).alias(f"a{p}") for p in BITS])
    y = few.select("token", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"), F.col("level").alias("vb"), *[F.col(p).alias(f"b{p}") for p in BITS])
    sizes = (F.col("na") * of >= F.col("nb") * similar) & (F.col("nb") * of >= F.col("na") * similar)
    apart = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in BITS), F.lit(0))
    near = apart * (of + similar) <= (F.col("na") + F.col("nb")) * (of - similar)
    on = (x["token"] == y["token"]) & (F.col("a") < F.col("b")) & sizes & (F.greatest("va", "vb") <= F.least("la", "lb")) & near
    pairs = x.join(y, on).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.least("la", "lb")).alias("asked"))
    return pairs.filter("shared >= asked").select("a", "b").union(listed(many, similar, of))


def held_against(rows: DataFrame, key: str, pivots: DataFrame, block: int) -> DataFrame:
    """rows (with key, sig and members, how many have the key) beside the pivot of their key, of which there is one at most.

    A key's rows are dealt to as many salts as it has blocks, and its pivot is copied to each of them.
    """
    salts = F.ceil(F.col("members") / block).cast("int")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("sig", F.lit("salt")), salts).cast("int"))
    copies = pivots.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("members")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def banded(rows: DataFrame, key: str, n, similar: int, of: int) -> DataFrame:
    """rows, with band, a value for each key and band of sizes n: two sets of one key that sizes let be linked share a band.

    A band is BAND times as wide, in logarithms, as the sizes of linked sets may differ; sets that larger ones of the next
    band may be linked with are in that one too.
    """
    wide = float(np.log(of / similar)) * (1 + 1e-9)
    at = F.log(n.cast("double")) / (BAND * wide) if similar < of else n.cast("double")
    over = F.floor(at + 1 / BAND) if similar < of else F.floor(at)
    return rows.withColumn("band", F.explode(F.array_distinct(F.array(F.floor(at), over)))).withColumn("band", F.concat_ws("/", F.col(key), F.col("band")))


def meetings(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows (with key, sig and main) in the cells where they meet: any two of one key do, unless both are main.

    Rows of either kind are parted into blocks by hash; a cell holds two blocks.  A key whose rows are all main has none.
    """
    per = rows.groupBy(key).agg(F.ceil(F.count_if("main") / block).cast("int").alias("_m"), F.ceil(F.count_if(~F.col("main")) / block).cast("int").alias("_r")).filter("_r > 0")
    rows = rows.join(per, key).withColumn("_b", F.pmod(F.xxhash64("sig"), F.when(F.col("main"), F.col("_m")).otherwise(F.col("_r"))).cast("int"))
    cell = lambda kind, i, j: F.concat_ws(":", F.lit(kind), F.col(key), i, j)
    up_to = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    rest = F.concat(F.transform(up_to(F.col("_r")), lambda j: cell("r", F.least("_b", j), F.greatest("_b", j))), F.transform(up_to(F.col("_m")), lambda j: cell("m", j, F.col("_b"))))
    main = F.transform(up_to(F.col("_r")), lambda i: cell("m", F.col("_b"), i))
    return rows.withColumn("cell", F.explode(F.when(F.col("main"), main).otherwise(rest))).drop("_m", "_r", "_b")


def listed(many: DataFrame, similar: int, of: int) -> DataFrame:
    """a and b: pairs enough to connect, list by list, all sets that sizes and parity sketches let be linked.

    All sets of a list are held against its first one; those that may not be linked with it meet the others of their band of
    sizes in cells of two blocks.
    """
    rows = many.withColumnRenamed("df", "members")
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"a{p}"))) for p in BITS), F.lit(0))
    sizes = (F.col("n") * of >= F.col("na") * similar) & (F.col("na") * of >= F.col("n") * similar)
    near = sizes & (apart * (of + similar) <= (F.col("n") + F.col("na")) * (of - similar))
    pivots = rows.groupBy("token").agg(F.min(F.struct("sig", "n", *BITS)).alias("one"), F.first("members").alias("members"))
    pivots = pivots.select("token", "members", F.col("one.sig").alias("a"), F.col("one.n").alias("na"), *[F.col(f"one.{p}").alias(f"a{p}") for p in BITS])
    rows = stored(held_against(rows, "token", pivots, LIST_BLOCK).select("token", "sig", "n", *BITS, "a", near.alias("main")), "jaccard-lists-pivots")
    bands = banded(rows.drop("a"), "token", F.col("n"), similar, of)
    met = stored(meetings(bands, "band", LIST_BLOCK).select("cell", "n", "sig", "main", *BITS), "jaccard-lists-cells")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in f.groupby("cell", sort=False):
            n, sig, bits = g["n"].to_numpy().astype(np.int64), g["sig"].to_numpy(), g[BITS].to_numpy().view(np.uint64)
            up = list(range(len(g)))
            for x in np.flatnonzero(~g["main"].to_numpy()).tolist():
                apart = np.bitwise_count(bits ^ bits[x]).sum(axis=1, dtype=np.int64)
                for y in np.flatnonzero((apart * (of + similar) <= (n[x] + n) * (of - similar)) & (n[x] * of >= n * similar) & (n * of >= n[x] * similar)).tolist():
                    a, b = root(up, x), root(up, y)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        out.append((sig[x], sig[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    lots = max(1, -(-met.count() // BLOCK))
    found = met.groupBy(F.pmod(F.xxhash64("cell"), F.lit(lots)).alias("lot")).applyInPandas(compare, "a long, b long")
    return rows.filter("main AND sig <> a").select("a", F.col("sig").alias("b")).union(found)


def root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = i = up[up[i]]
    return i


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sets (the diagonal means nothing), by whichever is less work: their incidence matrix, or the lists of their common tokens."""
    n = len(sets)
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    times = np.bincount(at, minlength=len(tokens))
    keep = times[at] > 1
    row, col = row[keep], (np.cumsum(times > 1) - 1)[at[keep]]
    times = times[times > 1]
    many = len(times)
    if n * n * many < 100 * int((times * times).sum()):
        out, width = np.zeros((n, n), dtype=np.float32), min(max(many, 1), max(1024, (1 << 22) // n))
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for start in range(0, many, width):
            a, b = np.searchsorted(col, (start, start + width))
            m = np.zeros((n, width), dtype=np.float32)
            m[row[a:b], col[a:b] - start] = 1
            out += m @ m.T
        return np.rint(out).astype(np.int64)
    by_token = row[np.argsort(col, kind="stable")]
    first = np.concatenate([[0], np.cumsum(times)[:-1]])
    ends = np.cumsum(np.bincount(row, minlength=n))  # row ascends
    out = np.empty((n, n), dtype=np.int64)
    for i in range(n):
        c = col[ends[i - 1] if i else 0 : ends[i]]
        each = times[c]
        place = np.repeat(first[c] - np.cumsum(each) + each, each) + np.arange(each.sum())
        out[i] = np.bincount(by_token[place], minlength=n)
    return out


def verified(members: DataFrame, similar: int, of: int) -> DataFrame:
    """a and b: links enough to connect all that is linked in each cell of members (sig, main, cell, grams) between sets of which one is not main."""

    def links(lot: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in lot.groupby("cell", sort=False):
            if len(cell) < 2:
                continue
            sig, main, sets = cell["sig"].to_numpy(), cell["main"].to_numpy(), [np.asarray(x).view(np.uint64) for x in cell["grams"]]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            both = overlaps(sets)
            linked = (of * both >= similar * (n[:, None] + n[None, :] - both)) & ~(main[:, None] & main[None, :])
            up = list(range(len(sets)))
            for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                a, b = root(up, i), root(up, j)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((sig[i], sig[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    lots = max(1, -(-members.count() // BLOCK))
    return members.withColumn("lot", F.pmod(F.xxhash64("cell"), F.lit(lots))).groupBy("lot").applyInPandas(links, "a long, b long")


def sets_of(texts: DataFrame, gram: int) -> DataFrame:
    """texts (sig, label, members, text) with grams, the set itself, in place of the text."""

    def run(batches):
        grams = Grams(gram)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                made = [grams(t).view(np.int64) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(made, pa.list_(pa.int64()))], names=["sig", "label", "members", "grams"])

    return texts.select("sig", "label", "members", "text").mapInArrow(run, "sig long, label long, members long, grams array<long>")


def links_of(sets: DataFrame, similar: int, of: int) -> DataFrame:
    """a and b: links enough to connect all that is linked in each cluster of sets (of sets_of()).

    A cluster of up to BLOCK sets is one cell.  The sets of a larger one are held against PIVOTS pivots, each of them a set
    that the pivots before it don't reach; what the links to pivots join with the first pivot needs no more verification
    among itself.  The others meet all sets of their band of sizes.
    """
    small = sets.filter(F.col("members") <= BLOCK).select("sig", F.lit(False).alias("main"), F.concat_ws(":", F.lit("c"), "label").alias("cell"), "grams")
    large = sets.filter(F.col("members") > BLOCK)
    found = verified(small, similar, of)
    if large.isEmpty():
        return stored(found, "jaccard-links")
    both = F.size(F.array_intersect("grams", "agrams"))
    close = of * both >= similar * (F.size("grams") + F.size("agrams") - both)
    links, open_ = None, large
    for turn in range(PIVOTS):
        pivots = open_.groupBy("label").agg(F.min_by(F.struct("sig", "grams"), F.xxhash64("sig", F.lit(turn))).alias("one"), F.first("members").alias("members"))
        pivots = pivots.select("label", "members", F.col("one.sig").alias("a"), F.col("one.grams").alias("agrams"))
        near = held_against(large, "label", pivots, BLOCK).filter(close).select("label", "a", F.col("sig").alias("b"), F.lit(turn).alias("turn"))
        near = stored(near, f"jaccard-pivot-{turn}")
        links = near if links is None else links.union(near)
        open_ = large.join(links.select(F.col("b").alias("sig")), "sig", "left_anti")
    parts = components(links.select("a", "b"), "jaccard-pivots").select(F.col("node").alias("sig"), F.col("label").alias("part"))
    # a pivot is linked with itself, so a first pivot without others is a part of its own
    firsts = links.filter("turn = 0").select("label", F.col("a").alias("sig")).distinct().join(parts, "sig", "left").select("label", F.coalesce("part", "sig").alias("first"))
    main = F.coalesce(F.col("part"), F.col("sig")) == F.col("first")
    firsts = firsts.join(large.groupBy("label").agg(F.first("members").alias("members")), "label")
    told = held_against(large.join(parts, "sig", "left"), "label", firsts, BLOCK).select("label", "sig", "grams", main.alias("main"))
    bands = banded(told, "label", F.size("grams"), similar, of)
    met = stored(meetings(bands, "band", BLOCK).select("sig", "main", "cell", "grams"), "jaccard-cells")
    return stored(found.union(links.select("a", "b")).union(verified(met, similar, of)), "jaccard-links")


def clustered(rows: DataFrame, told: DataFrame, gram: int, similar: int, of: int, sketch, unsure: frozenset[int]) -> DataFrame:
    """node (a sig) and label: the clusters of sets that are to be looked at together.  What it stores on the way is deleted."""
    with tidy(rows.sparkSession) as keep:
        entries = stored(prefixes(rows, gram, similar, of, sketch, told.count(), unsure), "jaccard-prefixes")
        shared = stored(entries.groupBy("token").agg((F.min("sig") != F.max("sig")).alias("several")).filter("several").select("token"), "jaccard-tokens")
        lists = stored(entries.join(shared, "token").groupBy("token", "sig").agg(*[F.min(c).alias(c) for c in ("n", "l", "level")]), "jaccard-lists")
        released(entries, shared)
        counts = lists.groupBy("token").agg(F.count("*").alias("df"))
        odd = told.groupBy("sig").agg(*[F.first(p).alias(p) for p in BITS])
        together = looked_at(stored(lists.join(counts, "token").join(odd, "sig"), "jaccard-counted"), similar, of)
        return keep(components(together, "jaccard-clusters"))


def labelled(rows: DataFrame, told: DataFrame, clusters: DataFrame, gram: int, similar: int, of: int) -> DataFrame:
    """sig and label of the sets that have links, verified within the clusters.  What it stores on the way is deleted."""
    with tidy(rows.sparkSession) as keep:
        one = told.groupBy("sig").agg(F.min(F.struct("id", "key")).alias("one"))
        named = stored(clusters.join(one, F.col("node") == F.col("sig")).select("sig", "one.*", "label"), "jaccard-named")
        members = named.groupBy("label").agg(F.count("*").alias("members"))
        text = rows.join(named.join(members, "label").hint("merge"), ["id", "key"]).select("sig", "label", "members", "text")
        if told.count() != told.select("id", "key").distinct().count():  # rows that repeat each other give one set
            text = text.dropDuplicates(["sig"])
        links = links_of(stored(sets_of(text, gram), "jaccard-grams"), similar, of)
        return keep(components(links, "jaccard-linked")).withColumnRenamed("node", "sig")


def linked(docs: DataFrame, gram: int = GRAM, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """id, key (hash of the text), n_shingles, component_id and first of every row of docs (doc_id, text), similarity being at least similar / of.

    component_id is the smallest id reachable by links, the row's own included, and first tells the one row (or rows equal
    in id and text) of each component that stands for it; rows without words are linked with
    nothing.  Texts with one set of n-grams are linked; repeated rows give repeated results.  Rows with a null id link
    others but are no smallest id, unless all are null.  An empty table gives an empty result; other columns play no
    part.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    with tidy(spark) as keep:
        bits = sketch_bits(rows.count())
        made = stored(described(rows, gram, bits), "jaccard-sets")
        sketch = spark.sparkContext.broadcast(summed(made.filter("id IS NULL").select("chunk", "counts"), bits))  # of 2 ** SKETCH_BITS[1] slots at most
        told = made.filter("id IS NOT NULL").drop("chunk", "counts")
        unsure = ambiguous(told)
        if unsure:
            told = told.withColumn("sig", F.when(F.col("sig").isin(*unsure), F.col("other")).otherwise(F.col("sig")))
        clusters = clustered(rows, told, gram, similar, of, sketch, unsure)
        labels = labelled(rows, told, clusters, gram, similar, of)
        own = F.when(F.col("n") > 0, F.col("sig"))
        full = told.select("id", "key", "n", own.alias("node")).join(labels.withColumnRenamed("sig", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        full = keep(stored(full, "jaccard-labelled"))
    null = F.col("id") == -(2**63)
    shown = F.when(~null, F.col("id"))
    least = full.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("rows"), F.min(shown).alias("least"), F.min(F.struct(null.alias("null"), "id", "key")).alias("head"))
    least = least.filter("rows > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("rows")
    out = full.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")).join(least, ["label", "salt"], "left")
    first = F.col("head").isNull() | ((F.col("head.id") == F.col("id")) & (F.col("head.key") == F.col("key")))
    return out.select(shown.alias("id"), "key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", shown).alias("component_id"), first.alias("first"))


def one_of_each(docs: DataFrame, gram: int = 5, similar: int = 80, of: int = 100) -> DataFrame:
    """docs with one document of each component, that of the smallest id; columns unchanged.  Rows that repeat another in id and text go."""
    found = linked(docs, gram, similar, of).filter("first").select(F.coalesce("id", F.lit(-(2**63))).alias("_id"), F.col("key").alias("_key"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), text_key(F.col("text")).alias("_key"))
    return rows.join(found, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("_doc.*")


def op5_ngram_jaccard(spark, sf_dir):
    found = linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLES: dict[str, str] = {}
