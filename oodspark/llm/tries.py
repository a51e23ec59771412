"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns are numbered within their conversations by ranges of the order and running sums over the ranges.  A node is told by
running sums of the hashes of the turns down to it, so every row names its node and the node's parent without any walk
along the conversation.

Totals of subtrees: leaves are raked into their parents and chains of nodes with one child each are compressed into what
ends them, in turns, until the root alone is left.  Chains are followed by jumps over ever longer stretches.  Then the
contracted nodes are expanded again, the last ones first, each from the total of what ended its chain.  Every round is
a few joins and is written to the shared folder.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import dropped, stored, table

#: A conversation takes its first turns from that of the next lower multiple of EVERY, fewer than SHARED of them.
EVERY, SHARED = 100, 6
#: Running sums inside a conversation go by so many turns, and so many nodes of a chain learn its total together.
STRETCH = 4096
#: Ids that are written as one text before they are hashed.
RUN = 256
NOTHING = hashlib.sha256().hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, at, role and text hashed (one, two) and chars of each turn with an id, parts being ranges of the order.

    Turns go by turn (null first), then by role and text; equal rows are interchangeable.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    rows = rows.filter("conv_id IS NOT NULL").withColumn("tie", F.rand(1)).repartitionByRange(*order, "tie").sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("one"), F.xxhash64("text", "role", F.lit("two")).alias("two"), F.length("text").cast("long").alias("chars"))
    return rows.withColumn("part", F.shiftright("at", 33))


def rebuilt(conversations: DataFrame, every: int = EVERY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place from 1, one, two, chars) of the rebuilt conversations, and their ids, of those without turns too.

    Conversation c begins with the first h original turns of c - c % every (all if fewer, none if it is absent), and its
    own turns after its first h follow; h is the CRC-32 of the decimal c modulo shared.
    """
    turns = stored(numbered(conversations), "trie-turns")
    h = F.crc32(F.col("conv_id").cast("string")) % shared
    base = F.col("conv_id") - F.col("conv_id") % every
    per = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of = Window.partitionBy("conv_id")  # a row for each range that the conversation lies in
    ahead = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("conv_id", "part", "first", ahead.alias("ahead"), F.sum("n").over(of).alias("n"), h.alias("h"), base.alias("base"))
    sizes = per.filter("conv_id = base").select("base", F.col("n").alias("base_n")).distinct()
    per = stored(per.join(sizes, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"), "trie-parts")
    rows = turns.join(per, ["conv_id", "part"]).withColumn("old", F.col("at") - F.col("first") + 1 + F.col("ahead"))
    ids = per.select("conv_id", "h", "base").distinct()
    own = rows.filter("old > h").select("conv_id", (F.col("old") - F.col("h") + F.col("given")).alias("place"), "one", "two", "chars")
    heads = rows.filter((F.col("base") == F.col("conv_id")) & (F.col("old") < shared)).select("base", F.col("old").alias("place"), "one", "two", "chars")
    begun = ids.join(heads, "base").filter("place <= h").select("conv_id", "place", "one", "two", "chars")
    return own.union(begun), ids.select("conv_id")


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent and chars (of the last turn) of every prefix of every conversation, from the empty one.

    node is an MD5 of the depth and of running sums over both hashes of the turns, each taken together with its place, in
    halves of 32 bits: two different prefixes have one node only if both 64-bit sums meet.
    """
    place = F.col("place")
    turns = turns.withColumn("_a", F.xxhash64("place", "one", "two")).withColumn("_b", F.xxhash64("two", "one", "place"))
    halves = {"_s0": F.shiftrightunsigned("_a", 32), "_s1": F.col("_a").bitwiseAND(0xFFFFFFFF), "_s2": F.shiftrightunsigned("_b", 32), "_s3": F.col("_b").bitwiseAND(0xFFFFFFFF)}
    turns = turns.select("conv_id", "place", "chars", F.floor((place - 1) / STRETCH).alias("stretch"), *[x.alias(s) for s, x in halves.items()])
    sums = turns.groupBy("conv_id", "stretch").agg(*[F.sum(s).alias(f"{s}all") for s in halves])
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "stretch", *[F.sum(f"{s}all").over(before).alias(f"{s}all") for s in halves]).filter("stretch > 0")
    within = Window.partitionBy("conv_id", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("*", *[F.sum(s).over(within).alias(f"{s}in") for s in halves]).join(sums, ["conv_id", "stretch"], "left")
    total = {s: F.col(f"{s}in") + F.coalesce(f"{s}all", F.lit(0)) for s in halves}
    node = lambda depth, sums: F.unhex(F.md5(F.concat_ws(":", depth, *sums)))
    rows = rows.select("conv_id", place.alias("depth"), node(place, total.values()).alias("node"), node(place - 1, [total[s] - F.col(s) for s in halves]).alias("parent"), "chars")
    root = node(F.lit(0), [F.lit(0)] * 4)
    return rows.union(ids.select("conv_id", F.lit(0).cast("long"), root, F.lit(None).cast("binary"), F.lit(0).cast("long")))


def compressed(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame | None]:
    """live without the chains of nodes with one child, and these: node, end (what ends the chain), steps to it, saved and leaves from node to just above end."""
    unary = live.filter("kids = 1 AND parent IS NOT NULL")
    if unary.isEmpty():
        return live, None
    child = live.select(F.col("parent").alias("node"), F.col("node").alias("end"), F.col("up_saved").alias("cs"), F.col("up_leaves").alias("cl"), (F.col("kids") == 1).alias("open"))
    chain = unary.join(child, "node").select("node", "end", F.lit(1).cast("long").alias("steps"), (F.col("saved") + F.col("cs")).alias("saved"), (F.col("leaves") + F.col("cl")).alias("leaves"), "open")
    chain = stored(chain, f"trie-chain-{turn}")
    inner = stored(chain.filter("open").select(F.col("end").alias("node")), f"trie-inner-{turn}")
    jump = 0
    while not chain.filter("open").isEmpty():
        jump += 1
        over = chain.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("steps").alias("n"), F.col("saved").alias("s"), F.col("leaves").alias("l"), F.col("open").alias("o"))
        further = chain.filter("open")
        for _ in range(2):  # two stretches on; those that end before keep what they have
            plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
            further = further.join(over, "end", "left").select("node", F.coalesce("far", "end").alias("end"), plus("steps", "n"), plus("saved", "s"), plus("leaves", "l"), F.coalesce("o", F.lit(False)).alias("open"))
        before, chain = chain, stored(chain.filter("NOT open").union(further), f"trie-chain-{turn}-{jump}")
        dropped(before)
    tops = chain.join(inner, "node", "left_anti").select("node", F.col("end"), F.col("saved").alias("s"), F.col("leaves").alias("l"))
    tops = unary.select("node", F.col("parent").alias("far"), "up_saved", "up_leaves").join(tops, "node")
    tops = tops.select(F.col("end").alias("node"), "far", (F.col("s") + F.col("up_saved")).alias("s"), (F.col("l") + F.col("up_leaves")).alias("l"))
    rest = live.filter("NOT (kids = 1 AND parent IS NOT NULL)").join(tops, "node", "left")
    rest = rest.select("node", F.coalesce("far", "parent").alias("parent"), "saved", "leaves", F.coalesce("s", "up_saved").alias("up_saved"), F.coalesce("l", "up_leaves").alias("up_leaves"), "kids")
    return rest, chain


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """node, saved and leaves summed over the subtree of each of nodes (node, parent, saved, leaves, kids), of one root."""
    live = stored(nodes.select("node", "parent", "saved", "leaves", F.lit(0).cast("long").alias("up_saved"), F.lit(0).cast("long").alias("up_leaves"), "kids"), "trie-live-0")
    raked, chains, turn = [], [], 0
    while not live.isEmpty():
        turn += 1
        before = live
        rest, chain = compressed(live, turn)
        rest = stored(rest, f"trie-compressed-{turn}")
        chains.append(chain)
        leaves = rest.filter("kids = 0")
        raked.append(stored(leaves.select("node", "saved", "leaves"), f"trie-raked-{turn}"))
        given = leaves.groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("saved") + F.col("up_saved")).alias("s"), F.sum(F.col("leaves") + F.col("up_leaves")).alias("l"), F.count("*").alias("gone"))
        left = rest.filter("kids > 0").join(given, "node", "left")
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        live = stored(left.select("node", "parent", plus("saved", "s"), plus("leaves", "l"), "up_saved", "up_leaves", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids")), f"trie-live-{turn}")
        dropped(before, rest)
    totals = None
    for turn in range(len(raked), 0, -1):
        totals, chain = raked[turn - 1] if totals is None else totals.union(raked[turn - 1]), chains[turn - 1]
        if chain is not None:
            # a long chain meets the total of its end by stretches
            stretch = F.floor(F.col("steps") / STRETCH)
            ends = chain.groupBy("end").agg(F.max(stretch).alias("most")).join(totals.select(F.col("node").alias("end"), F.col("saved").alias("s"), F.col("leaves").alias("l")), "end")
            ends = ends.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), "most"))).drop("most")
            out = chain.withColumn("stretch", stretch).join(ends, ["end", "stretch"])
            totals = totals.union(stored(out.select("node", (F.col("saved") + F.col("s")).alias("saved"), (F.col("leaves") + F.col("l")).alias("leaves")), f"trie-expanded-{turn}"))
    return totals if totals is not None else nodes.select("node", "saved", "leaves")


def digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256, of the decimal conv_ids of each node in ends (node, conv_id), ascending and joined by commas.

    Ids are sorted by ranges and written as texts of some hundred each there, by many tasks even for one node.  SHA-256
    itself goes from front to back, so the texts of a node pass through one task, which holds none but the current ones.
    """

    def written(batches):
        for b in batches:
            out = []
            for node, run in itertools.groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), key=lambda r: r[0]):
                ids = [r[1] for r in run]
                out += [(node, ids[i], ",".join(map(str, ids[i : i + RUN]))) for i in range(0, len(ids), RUN)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["node", "first", "ids"])

    def hashed(batches):
        current = digest = None
        for b in batches:
            nodes, texts = [], []
            for node, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if node == current:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    nodes.append(current)
                    texts.append(digest.hexdigest())
                current, digest = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(texts, pa.string())], names=["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    dealt = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    runs = dealt.mapInArrow(written, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = EVERY, shared: int = SHARED) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations (see rebuilt()).

    conversations has conv_id, turn, role and text; other columns play no part.  Null roles and texts are empty, and
    turns of a null conv_id belong to no conversation.  Turns of one number go by role, then text, and repeated rows are
    repeated turns.  Texts count whole, whatever their length.  No conversation gives no rows.

    conv_id is the smallest member, depth the number of turns, parent_conv_id the parent's conv_id (root: null), n_convs the
    members, n_children the children, n_leaves the childless nodes of the subtree, saved_tokens the sum over the subtree of
    (n_convs - 1) times the code points of the last text, and ends_sha256 tells the members that end here.
    """
    rows = stored(prefixes(*rebuilt(conversations, every, shared)), "trie-prefixes")
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    nodes = stored(nodes, "trie-nodes")
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, "node", "left").fillna(0, ["n_children"]), "trie-counted")
    totals = subtree_totals(nodes.select("node", "parent", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("n_children").alias("kids")))
    told = digests(rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")))
    # the children of one node may be very many: adaptive execution splits them, since nothing but a write follows
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(above, "parent", "left"), "trie-parents")
    out = nodes.join(totals.withColumnsRenamed({"saved": "saved_tokens", "leaves": "n_leaves"}), "node").join(told, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
ORACLE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
o AS (SELECT c.conv_id, p, r, x FROM c JOIN t ON t.conv_id = base WHERE p <= h UNION ALL SELECT c.conv_id, p, r, x FROM c JOIN t USING (conv_id) WHERE p > h),
m AS (SELECT conv_id, row_number() OVER w AS d, list(md5(len(r) || ':' || r || x)) OVER w AS key, len(x) AS chars FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY p) UNION ALL SELECT conv_id, 0, [], 0 FROM c),
k AS (SELECT conv_id, d, chars, min(conv_id) OVER (PARTITION BY key) AS node FROM m),
n AS (SELECT node, d, count(*) AS n_convs, any_value(chars) AS chars FROM k GROUP BY ALL),
u AS (SELECT n.*, k.node AS up FROM n LEFT JOIN k ON k.conv_id = n.node AND k.d = n.d - 1),
q AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN q USING (node, d)),
s AS (SELECT k.node, k.d, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens FROM v JOIN k ON k.conv_id = v.node AND k.d <= v.d GROUP BY ALL),
e AS (SELECT node, d, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS told FROM (SELECT conv_id, arg_max(node, d) AS node, max(d) AS d FROM k GROUP BY conv_id) GROUP BY ALL)
SELECT node AS conv_id, d AS depth, up AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(told, sha256('')) AS ends_sha256 FROM v JOIN s USING (node, d) LEFT JOIN e USING (node, d)"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": ORACLE}
