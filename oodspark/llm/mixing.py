"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key.  Keys are dealt to ranges within each source, words are summed per range, and
running sums over the ranges and inside each range give every document's offset in its source's random order without
any task holding a whole source.  The source's budget of words then cuts that order: whole epochs first, and the rest
of the budget from the start of the order, the last document in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import GAP, WORD, stored, words

#: Cyclic weights of the sources in code point order, null last.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source is repeated at most so often.
MOST_EPOCHS = 3
#: Aim for rows in a key range.  The result doesn't depend on it.
RANGE_ROWS = 2048
SEED = "mix-1"
KEY_BITS = 60


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size (words of the whole text, null text: 0), key (of the id) and the columns in keep.

    Whole texts of any length count.  Columns of docs named size or key are not read.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.regexp_replace(text, f"^{GAP}", "")
    size = F.when(trimmed == "", 0).otherwise(F.size(F.split(F.regexp_replace(trimmed, f"{GAP}$", ""), GAP, -1)))
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", *keep, size.cast("long").alias("size"), key.alias("key"))


def targets(sized: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, n_docs, target: share of all words dealt by weight, no source above most times its size.

    The excess of capped sources is dealt anew by weight until no source is above: that is the level at which the
    capped shares add up to the whole, found in closed form from running sums over the sources in order of size per
    weight.  The table has a row for each source.  A source without words has target 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # the sources are a bounded vocabulary of the corpus: these windows see one row for each source
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(F.lit(0)), order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / left)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.max(F.when(fits, F.col("level"))).over(whole))  # the first that fits
    return per.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mixed(sized: DataFrame, **how) -> DataFrame:
    """sized (of sizes()) with source_size, target, taken (words taken, repeats counted) and epochs (whole ones).

    Rows that repeat an id, null ids among them, lie next to each other in one key range, the shorter first; rows equal in
    id and size are interchangeable.
    Reruns, other partitionings and other range sizes give the same mix.  An empty table gives an empty mix.
    """
    ranges = max(1, -(-sized.count() // RANGE_ROWS))
    part = F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("double") / float(2**KEY_BITS)
    # "s" is never null, so that the null source meets itself
    rows = sized.withColumn("s", F.struct("source")).withColumn("range", F.floor(part * ranges))
    per = targets(sized, **how).withColumn("s", F.struct("source")).drop("source", "n_docs")
    sums = rows.groupBy("s", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(ahead), F.lit(0))).drop("range_size").join(per, "s")
    inside = Window.partitionBy("s", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["s", "range"])
    rows = rows.withColumn("start", F.col("start") + F.col("range_start")).withColumn("budget", F.round("target").cast("long"))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start")
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest)))
    return rows.drop("s", "range", "range_start", "start", "budget", "key")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs, once for each epoch they are taken in, with n_chars to match.

    A row that the budget cuts keeps its first words, joined by one space.  Rows without words take no part in the
    budget; they are kept once.
    """
    # two hashes and the length: what tells rows apart
    row = F.struct(F.xxhash64("doc_id", "text", "source").alias("a"), F.xxhash64(F.lit("b"), "source", "text", "doc_id").alias("b"), F.length("text").alias("n")).alias("_row")
    sized = stored(sizes(docs.select("doc_id", "source", "text", row), "_row"), "mix")
    rows = mixed(sized, **how).groupBy("_row").agg(F.first("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_times"))
    # rows equal in id, text and source share their words evenly, the remainder going to the first of them
    both = docs.select(row, F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text")).join(rows, "_row")
    both = both.withColumn("_copy", F.row_number().over(Window.partitionBy("_row").orderBy("_size")))
    both = both.withColumn("_own", F.expr("_taken div _times + CASE WHEN _copy <= _taken % _times THEN 1 ELSE 0 END"))
    whole = F.expr("array_repeat(0L, CAST(CASE WHEN _size = 0 THEN 1 ELSE _own div _size END AS INT))")
    part = F.expr("CASE WHEN _size > 0 AND _own % _size > 0 THEN array(_own % _size) ELSE array() END").cast("array<long>")
    both = both.withColumn("_cut", F.explode(F.concat(whole, part)))
    first = F.array_join(F.slice(words(F.col("_text")), F.lit(1), F.col("_cut").cast("int")), " ")
    both = both.withColumn("_text", F.when(F.col("_cut") > 0, first).otherwise(F.col("_text")))
    return both.select(*[F.col("_text").alias("text") if c == "text" else F.length("_text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"_doc.{c}").alias(c) for c in docs.columns])


def op4_mix_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixed(stored(sizes(docs), "mix"))
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"))


ORACLE = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM r),
p AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN (budget // source_size) * size + least(size, greatest(0, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken FROM p"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES = {"op4_mix_sources": ORACLE}
