"""Near-duplicates by SimHash fingerprints, found in BK-trees.

Equal fingerprints are one point.  Points are dealt to shards: two points that differ in at most r bits agree on one of
r + 1 groups of bits, so the bits of each group make a shard.  A shard of too many points is parted in the same way by
the bits that it leaves free, until what is left free bounds its size.  Each shard gets a BK-tree, in which the children
of a node are keyed by their distance to it, and the tree goes to all points of its shard.  A search follows the edges
whose distance is within the radius of that of the point to the node.

All trees together grow with the corpus, so they are rows of a table that a shuffle brings to their queries.  Nothing is
gathered by the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, stored, table
from .components import components

#: Words of a shingle, seed of its hash, and most bits in which linked fingerprints differ.
GRAM, SEED, RADIUS = 3, 42, 2
#: Most points of a tree.
TREE = 4096
#: Points of the trees that one group of a task takes up, and nodes that its searches may stand at together.
LOT, STANDING = 65_536, 1 << 21
#: Shingles whose bits are counted at a time.
COUNTED = 65_536
#: Rows of one fingerprint are dealt to so many keys when they learn the smallest id.
SALTS = 16
#: A distance between two fingerprints is below this.
DISTANCES = 65


def fingerprint(text: bytes | None, gram: int = GRAM, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text in UTF-8, A-Z in lower case: a bit is 1 if it is in over half the hashes.

    A text of fewer words is one shingle; one without words has fingerprint 0.
    """
    words = (text or b"").lower().split()  # of bytes: A-Z, and the six characters that part words
    if not words:
        return 0
    line, width = memoryview(b" ".join(words)), min(gram, len(words))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(first), COUNTED):
        h = np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(first[i : i + COUNTED], last[i : i + COUNTED], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """id and fp (its bits as a long) of each row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, gram, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


def parted(mask: int, radius: int) -> list[int]:
    """mask with each of radius + 1 groups of the bits that it lacks, of about equal size."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]


def routed(points: DataFrame, radius: int = RADIUS, most: int = TREE, hot: list[DataFrame] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """fp, mask and value (of the bits in mask) of the shards of all points, and the parted shards level by level.

    By default the points themselves decide what is parted.  With the levels of other points, these are sent the same way.
    A shard that leaves b bits free has 2 ** b points at most, so levels end after a few.
    """
    if most < 1 << radius:
        raise ValueError("too few points in a tree for this radius")
    spark = points.sparkSession
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    shard = lambda rows, mask: rows.select("fp", mask.alias("mask"), F.col("fp").bitwiseAND(mask).alias("value"))
    rows, masks, out, found = shard(points, F.lit(0).cast("long")), [0], None, []
    while True:
        level = len(found)
        if hot is None:
            large = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("mask", "value")
            large = stored(large, f"simhash-parted-{level}")  # at most a row for each so many points
        elif level < len(hot):
            large = hot[level]
        if hot is not None and level == len(hot) or large.isEmpty():
            return (rows if out is None else out.union(rows)), found
        found.append(large)
        steps = [(m, signed(child)) for m in masks for child in parted(m % (1 << 64), radius)]  # (radius + 1) ** level rows
        masks = sorted({child for _, child in steps})
        twice = len(masks) < len(steps)
        steps = F.broadcast(spark.createDataFrame(steps, "mask long, child long"))
        if level:
            copies = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("large", F.lit(True))
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(copies, ["mask", "value", "salt"], "left").drop("salt")
            rows = stored(rows.select("fp", "mask", "value", "large"), f"simhash-level-{level}")
            rest = rows.filter("large IS NULL").drop("large")
            out, rows = rest if out is None else out.union(rest), rows.filter("large")
        rows = shard(rows.join(steps, "mask"), F.col("child"))
        rows = rows.distinct() if twice else rows  # two ways to one shard


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def grown(shard: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (roots: -1) and distance to it of every point, in a BK-tree for each shard.

    shard ascends and the points of a shard differ.  The trees are those of inserting one point after the other; all
    points of all trees go down one edge at a time together.
    """
    n = len(fps)
    up, edge, todo = np.full(n, -1), np.zeros(n, dtype=np.int64), np.arange(n)
    _, at = np.unique(shard, return_index=True)
    at = np.repeat(at, np.diff(np.append(at, n)))
    todo = todo[at != todo]
    while len(todo):
        far = apart(fps[todo], fps[at[todo]])
        _, first, same = np.unique(at[todo] * DISTANCES + far, return_index=True, return_inverse=True)
        child = todo[first]
        up[child], edge[child] = at[child], far[first]
        at[todo] = child[same]
        todo = todo[at[todo] != todo]
    return up, edge


def matches(fps: np.ndarray, up: np.ndarray, edge: np.ndarray, query: np.ndarray, root: np.ndarray, size: np.ndarray, radius: int):
    """Places in query and in fps of what lies within the radius, in portions; root and size are those of each query's tree."""
    kids = np.flatnonzero(up >= 0)
    key = up[kids] * DISTANCES + edge[kids]
    order = np.argsort(key)
    kids, key = kids[order], np.append(key[order], -1)
    portion = np.cumsum(size) // STANDING
    for q in np.split(np.arange(len(query)), np.flatnonzero(np.diff(portion)) + 1):
        node = root[q]
        while len(q):
            far = apart(query[q], fps[node])
            near = far <= radius
            if near.any():
                yield q[near], node[near]
            ways = []
            for d in range(-radius, radius + 1):
                wanted = node * DISTANCES + far + d
                wanted[(far + d < 0) | (far + d >= DISTANCES)] = -2
                place = np.searchsorted(key[:-1], wanted)
                there = np.flatnonzero(key[place] == wanted)
                ways.append((q[there], kids[place[there]]))
            q, node = (np.concatenate(x) for x in zip(*ways, strict=True))


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what the links a, b connect: every linked value with the smallest one, itself left out."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        for ends in (x, y, label[x], label[y]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            rest = np.flatnonzero(label != np.arange(len(ids)))
            return ids[rest], ids[label[rest]]
        label = new


def shard_trees(members: DataFrame, lots: int) -> DataFrame:
    """lot, mask, value and the BK-tree (fps, up, edge; up counts from 0 in the tree) of each shard of members (fp, mask, value)."""

    def plant(t: pa.Table) -> pa.Table:
        mask, value, fps = (t.column(c).to_numpy() for c in ("mask", "value", "fp"))
        order = np.lexsort((fps, value, mask))
        mask, value, fps = mask[order], value[order], fps[order]
        head = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))) if len(fps) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(head, len(fps)))
        up, edge = grown(np.repeat(np.arange(len(head)), size), fps.view(np.uint64))
        ends = np.append(head, len(fps)).astype(np.int32)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
        lot = pa.array(np.full(len(head), t.column("lot")[0].as_py() if len(fps) else 0), pa.int64())
        inside = np.where(up < 0, -1, up - np.repeat(head, size))
        return pa.table({"lot": lot, "mask": mask[head], "value": value[head], "fps": lists(fps, pa.int64()), "up": lists(inside, pa.int32()), "edge": lists(edge, pa.int32())})

    return in_lots(members, lots).groupBy("lot").applyInArrow(plant, "lot long, mask long, value long, fps array<long>, up array<int>, edge array<int>")


def in_lots(rows: DataFrame, lots: int) -> DataFrame:
    return rows.withColumn("lot", F.pmod(F.xxhash64("mask", "value"), F.lit(lots)).cast("long"))


def within(queries: DataFrame, trees: DataFrame, lots: int, radius: int = RADIUS, links: bool = False) -> DataFrame:
    """a (of queries: fp, mask, value) and b (of trees), not equal and within the radius; a pair comes once for each shard that both are in.

    With links, only links enough to connect all that is linked, one for each linked fingerprint of a lot at most.
    """

    def search(q: pa.Table, t: pa.Table) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        a, b = [none], [none]
        if q.num_rows and t.num_rows:
            column = lambda c: t.column(c).combine_chunks()
            size = column("fps").value_lengths().to_numpy()
            head = np.cumsum(size) - size
            fps = column("fps").flatten().to_numpy().view(np.uint64)
            up, edge = (column(c).flatten().to_numpy().astype(np.int64) for c in ("up", "edge"))
            up = np.where(up < 0, -1, up + np.repeat(head, size))
            place = {shard: i for i, shard in enumerate(zip(column("mask").to_pylist(), column("value").to_pylist(), strict=True))}
            tree = np.array([place.get(s, -1) for s in zip(q.column("mask").to_pylist(), q.column("value").to_pylist(), strict=True)])
            ask = q.column("fp").to_numpy()[tree >= 0]
            tree = tree[tree >= 0]
            for x, y in matches(fps, up, edge, ask.view(np.uint64), head[tree], size[tree], radius):
                x, y = ask[x], fps[y].view(np.int64)
                other = x != y
                a.append(x[other])
                b.append(y[other])
                if links and sum(map(len, a)) > STANDING:
                    a, b = ([x] for x in connected(np.concatenate(a), np.concatenate(b)))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table(dict(zip("ab", connected(a, b) if links else (a, b), strict=True)), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    asked = in_lots(queries, lots)
    return asked.groupBy("lot").cogroup(trees.groupBy("lot")).applyInArrow(search, "a long, b long")


def linked_points(points: DataFrame, radius: int = RADIUS, most: int = TREE) -> DataFrame:
    """a and b: links enough to connect all distinct points (fp) that are within the radius of each other."""
    members, levels = routed(points, radius, most)
    members = stored(members, "simhash-members")
    dropped(*levels)
    shards = members.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1").drop("n")  # the others have no one to meet
    members = stored(members.join(shards, ["mask", "value"]), "simhash-shared")
    lots = max(1, -(-members.count() // LOT))
    trees = stored(shard_trees(members, lots), "simhash-trees")
    return within(members, trees, lots, radius, links=True)


def linked(docs: DataFrame, radius: int = RADIUS, gram: int = GRAM, seed: int = SEED, most: int = TREE) -> DataFrame:
    """id, fp and component_id of every row of docs (doc_id, text): the smallest id reachable over links, the row's own included.

    Two rows link if their fingerprints differ in at most radius bits, so those without words are all linked with each
    other.  Repeated rows give repeated results.  Rows with a null id link others, and are no smallest id unless all are
    null.  Whole texts of any length count, other columns play no part, and an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, gram, seed), "simhash-rows")
    points = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "simhash-points")
    labels = components(stored(linked_points(points.select("fp"), radius, most), "simhash-links"), "simhash").withColumnRenamed("node", "fp")
    points = points.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    groups = points.groupBy("label").agg(F.min("least").alias("group_least"), F.sum("rows").alias("group_rows")).filter("group_rows > 1").drop("group_rows")
    told = points.join(groups, "label").select("fp", F.col("group_least").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return rows.join(told, ["fp", "salt"], "left").select("id", "fp", F.coalesce("least", "id").alias("component_id"))


def op11_simhash_bktree(spark, sf_dir):
    found = linked(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op11_simhash_bktree": op11_simhash_bktree}
ORACLES: dict[str, str] = {}
