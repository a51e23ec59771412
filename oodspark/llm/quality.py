"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  Expectation-maximisation over the counts of vote
patterns estimates every rule's accuracy and the share of good documents, and a document is kept when its posterior
probability of being good reaches a threshold.  The pattern table has at most ``3 ** len(RULES)`` rows whatever the
corpus size, so the whole fit is one fold over one row of arrays; there is no loop of jobs on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored, words

#: name -> (vote for good, vote for bad); SQL that means the same in Spark and in DuckDB.  Otherwise the rule abstains.
RULES = {
    "length": ("n_words >= 40", "n_words < 20"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    "markup": ("100 * n_symbols <= word_chars", "25 * n_symbols >= word_chars"),
    "duplicate_lines": ("n_dup_lines = 0", "10 * n_dup_lines >= 3 * n_lines AND n_dup_lines > 0"),
    "repeats": ("100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    "capitals": ("100 * n_capitals <= 12 * word_chars", "100 * n_capitals >= 30 * word_chars"),
    "sentences": ("100 * n_stops >= 4 * n_words AND 100 * n_stops <= 40 * n_words", "100 * n_stops < 1 * n_words OR 100 * n_stops > 80 * n_words"),
}
ITERATIONS = 12
#: Before any document is seen: how often a rule that votes is right on good and on bad documents, and the good share.
START_GOOD, START_BAD, START_PRIOR = 0.99, 0.2, 0.7
#: Estimates stay inside these bounds: a rule seldom blames a good document, so the classes cannot swap and a kind of junk that
#: only one or two rules see is not taken for good because it is common.  No rule gets infinite weight.
BOUNDS = {"good": (0.99, 0.999), "bad": (0.1, 0.95), "prior": (0.5, 0.9)}
#: Bounds for corpora of many kinds: the fit may find that a rule blames up to half of the good documents, such as verse or
#: capitals, and then one such vote is no veto.  The classes keep their start; junk is told by rules that agree.
LEARNING = BOUNDS | {"good": (0.5, 0.999)}
#: Characters that end a sentence, as the content of a regular expression's class: ASCII only, and of all scripts.
STOPS = ".!?"
ALL_STOPS = STOPS + "\u037e\u0589\u061f\u06d4\u0700\u0701\u0702\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u166e\u1803\u1809\u17d4\u17d5\u2026\u203c\u203d\u2047\u2048\u2049\u3002\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61"
#: Votes that the start values count for in every estimate.
PSEUDO = 10.0
KEEP_AT = 0.5
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
WINDOW = 8


def signals(docs: DataFrame, *keep: str, stops: str = STOPS) -> DataFrame:
    """Counts per document over its whole text of any length (null text counts as empty), beside the columns named in keep.

    Other columns of docs are not read, whatever their names; a column in keep must not bear the name of a count.

    Windows of eight words are compared by 64-bit hash inside the row, so no window leaves its task; the positions are
    only worked out in texts where some window does repeat.
    """
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    ends = F.regexp_replace("_t", r"[^.!?]+" if stops == STOPS else r"[^.!?\x{80}-\x{10FFFF}]+", "")
    if stops != STOPS:  # the long class only sees what is not ASCII
        ends = F.regexp_replace(ends, f"[^{stops}]+", "")
    d = d.withColumns({"_w": words(F.col("_t")), "_l": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(ends).cast("long").alias("n_stops"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    for gap in (1, 2, 4):  # hashes of 2, 4 and then 8 words
        n = F.greatest(F.size("_h") - gap, F.lit(0))
        d = d.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get(F.col("_s"), i - 1)["h"]) | (x["h"] == F.get(F.col("_s"), i + 1)["h"])
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    step = F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(WINDOW))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def votes() -> str:
    """SQL array of the votes, closed by the constant vote of the prior."""
    return "array(" + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for good, bad in RULES.values()) + ", 1)"


#: Log odds that a document is good, given votes and the estimates p.
LOGIT = "aggregate(zip_with({votes}, {p}, (v, a) -> CASE v WHEN 1 THEN ln(a.g / (1 - a.b)) WHEN -1 THEN ln((1 - a.g) / a.b) ELSE 0D END), 0D, (s, y) -> s + y)"


def fitted(voted: DataFrame, bounds: dict | None = None) -> DataFrame:
    """One row: for each rule how often its votes are right on good (g) and on bad documents (b), and last the good share, twice.

    The start values if there are no rows.  bounds are BOUNDS by default.
    """
    bounds = BOUNDS if bounds is None else bounds
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"))

    def clamped(kind: str, x: str) -> str:
        return f"least({bounds[kind][1]}D, greatest({bounds[kind][0]}D, {x}))"

    good = clamped("good", f"(aggregate(e, 0D, (s, x) -> s + x.n * CASE x.v[r] WHEN 1 THEN x.q ELSE 0D END) + {PSEUDO * START_GOOD}D) / (aggregate(e, 0D, (s, x) -> s + x.n * x.q * abs(x.v[r])) + {PSEUDO}D)")
    bad = clamped("bad", f"(aggregate(e, 0D, (s, x) -> s + x.n * CASE x.v[r] WHEN -1 THEN 1 - x.q ELSE 0D END) + {PSEUDO * START_BAD}D) / (aggregate(e, 0D, (s, x) -> s + x.n * (1 - x.q) * abs(x.v[r])) + {PSEUDO}D)")
    prior = clamped("prior", f"(aggregate(e, 0D, (s, x) -> s + x.n * x.q) + {PSEUDO * START_PRIOR}D) / (aggregate(e, 0D, (s, x) -> s + x.n) + {PSEUDO}D)")
    scored = f"transform(pats, x -> struct(x.votes AS v, x.n AS n, 1 / (1 + exp(-{LOGIT.format(votes='x.votes', p='p')})) AS q))"
    step = f"transform(array({scored}), e -> transform(p, (a, r) -> CASE WHEN r = {len(RULES)} THEN transform(array({prior}), z -> named_struct('g', z, 'b', z))[0] ELSE named_struct('g', {good}, 'b', {bad}) END))[0]"
    start = ", ".join([f"named_struct('g', {START_GOOD}D, 'b', {START_BAD}D)"] * len(RULES) + [f"named_struct('g', {START_PRIOR}D, 'b', {START_PRIOR}D)"])
    return row.select(F.expr(f"aggregate(sequence(1, {ITERATIONS}), array({start}), (p, i) -> {step})").alias("accuracy"))


def voted(features: DataFrame) -> DataFrame:
    return features.withColumn("votes", F.expr(votes())).withColumn("base_failed", F.expr(BASE_FAILED))


def judged(features: DataFrame, fit: DataFrame | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """features (of signals()) with posterior, base_failed and kept.

    A document under 20 words, or with over 30 % of its words in repeated windows, fails the base test and is never
    kept, and takes no part in the fit: its fate is settled, and it would teach the fit only what the base test
    already knows.  Any other is kept when its posterior reaches keep_at.  Repeated rows count once each; an empty
    table gives an empty result.  fit is a row of fitted(), by default that of the features.
    """
    rows = voted(features)
    out = rows.crossJoin(F.broadcast(fitted(rows.filter("NOT base_failed")) if fit is None else fit))  # one row
    out = out.withColumn("posterior", F.expr(f"1 / (1 + exp(-{LOGIT.format(votes='votes', p='accuracy')}))"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)).drop("votes", "accuracy")


def keep_good(docs: DataFrame, keep_at: float = KEEP_AT, bounds: dict | None = None, stops: str = STOPS) -> DataFrame:
    """Rows of docs that the rules keep, with their columns unchanged.

    The texts are read twice, for the fit and for the verdicts, and never moved.
    """
    fit = stored(fitted(voted(stored(signals(docs, stops=stops), "quality")).filter("NOT base_failed"), bounds), "quality-fit")
    rows = signals(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), "_doc", stops=stops)
    # a generator, through which the filter can't be pushed: it would repeat every expression that it uses
    rows = rows.select("_doc", F.inline(F.array(F.struct(*[c for c in rows.columns if c != "_doc"]))))
    return judged(rows, fit, keep_at).filter("kept").select("_doc.*")


def op10_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(stored(signals(docs, "doc_id"), "quality")).select(*columns)


def _oracle() -> str:
    rules, last = range(len(RULES)), len(RULES)
    vote = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{i}" for i, (good, bad) in enumerate(RULES.values()))
    logit = " + ".join([f"ln(g{last} / (1 - g{last}))", *(f"CASE v{i} WHEN 1 THEN ln(g{i} / (1 - b{i})) WHEN -1 THEN ln((1 - g{i}) / b{i}) ELSE 0 END" for i in rules)])

    def clamped(kind: str, x: str, name: str) -> str:
        return f"least({BOUNDS[kind][1]}, greatest({BOUNDS[kind][0]}, {x}))::DOUBLE AS {name}"

    est = [clamped("good", f"(coalesce(sum(n * CASE v{i} WHEN 1 THEN q ELSE 0 END), 0) + {PSEUDO * START_GOOD}) / (coalesce(sum(n * q * abs(v{i})), 0) + {PSEUDO})", f"g{i}") for i in rules]
    est += [clamped("bad", f"(coalesce(sum(n * CASE v{i} WHEN -1 THEN 1 - q ELSE 0 END), 0) + {PSEUDO * START_BAD}) / (coalesce(sum(n * (1 - q) * abs(v{i})), 0) + {PSEUDO})", f"b{i}") for i in rules]
    est += [clamped("prior", f"(coalesce(sum(n * q), 0) + {PSEUDO * START_PRIOR}) / (coalesce(sum(n), 0) + {PSEUDO})", f"g{last}")]
    steps = [f"p0 AS (SELECT {', '.join([*(f'{START_GOOD}::DOUBLE AS g{i}, {START_BAD}::DOUBLE AS b{i}' for i in rules), f'{START_PRIOR}::DOUBLE AS g{last}'])})"]
    for k in range(ITERATIONS):
        steps += [f"e{k} AS MATERIALIZED (SELECT pats.*, 1 / (1 + exp(-({logit}))) AS q FROM pats, p{k})", f"p{k + 1} AS MATERIALIZED (SELECT {', '.join(est)} FROM e{k})"]
    return f"""WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM base),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest(range(8)) AS k) GROUP BY rid),
f AS MATERIALIZED (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(t, '[^.!?]+', '', 'g'))::BIGINT AS n_stops, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
v AS MATERIALIZED (SELECT *, {vote} FROM f),
pats AS MATERIALIZED (SELECT {', '.join(f'v{i}' for i in rules)}, count(*)::DOUBLE AS n FROM v WHERE NOT ({BASE_FAILED}) GROUP BY ALL),
{', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({logit}))) >= {KEEP_AT} AS kept FROM v, p{ITERATIONS}"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _oracle()}
