"""Language identification: known words first, then shorter and shorter character n-grams.

A known word adds its log frequency in each language.  A word that the fit never saw is scored by its character
n-grams of the greatest length of which some are known.  The posterior over languages of the whole text gives the
prediction and its score.  Letters are the characters of Unicode category L, in the fit and in predictions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drawn, held_out, stored

#: The fit reads about so many labelled documents at most, chosen by hash of the id; all their words and n-grams are kept.
FIT_ROWS = 5_000
LENGTHS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"
REMEMBERED = 200_000
#: Runs of letters and of what else can be part of a number, and the letters in such a run.
RUN, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters of a text in lower case."""
    found = RUN.findall((text or "").lower())
    return found if "".join(found).isalpha() or not found else [w for run in found for w in LETTERS.findall(run)]


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """lang and text of about so many of the rows that are not held out and have a language; all of them, if there are fewer.

    Rows are drawn by a hash of id and text, so those equal in both go together.
    """
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    return known.filter(drawn(F.xxhash64("doc_id", "text", F.lit("language")), rows, known.select("doc_id").count())).select("lang", "text")


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Word and n-gram log frequencies per language, from the documents that are not held out and have a language.

    Counting is a Spark aggregation; what reaches the driver, as columns, is the counts of the words and n-grams of the
    sample, which rows bounds.  No labelled document gives a model without languages, which predicts "und" for all.
    """
    words = sample(docs, rows).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("unit"))
    counts = stored(words.groupBy("unit", "lang").count(), "language-words")
    padded = F.concat(F.lit("<"), "unit", F.lit(">"))

    def cut(n: int):  # the n-grams of a word
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

    grams = counts.select("lang", "count", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), cut(n).alias("g")) for n in LENGTHS])).alias("x"))
    grams = grams.select("lang", "count", F.col("x.n").alias("n"), F.explode("x.g").alias("unit")).filter(F.length("unit") == F.col("n"))
    grams = grams.groupBy("n", "unit", "lang").agg(F.sum("count").alias("count"))
    found = counts.select(F.lit(0).alias("n"), "unit", "lang", "count").unionByName(grams).toArrow()
    langs = sorted(x for x in found["lang"].unique().to_pylist())
    model: dict = {"langs": langs, "units": {}}
    for n in (0, *LENGTHS):
        part = found.filter(pc.equal(found["n"], n))
        units = part["unit"].unique().sort()
        table = np.full((len(units), len(langs)), SMOOTHING)
        at = pc.index_in(part["unit"], units).to_numpy(), pc.index_in(part["lang"], pa.array(langs, pa.string())).to_numpy()
        np.add.at(table, at, part["count"].to_numpy())
        model["units"][n] = ({u: i for i, u in enumerate(units.to_pylist())}, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32) if len(units) else table.astype(np.float32))
    return model


class Scorer:
    def __init__(self, model: dict):
        self.langs, units = model["langs"], model["units"]
        self.index, self.table = units[0]
        self.grams = [(n, *units[n]) for n in LENGTHS]
        self.none = np.zeros(len(self.langs))
        self.unseen: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's known n-grams of the greatest length that has any; nothing if none has."""
        padded = f"<{word}>"
        for n, index, table in self.grams:
            found = [index[g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in index]
            if found:
                return table[found].mean(axis=0, dtype=np.float64)
        return self.none

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        get, known, total = self.index.get, [], np.zeros(len(self.langs))
        for w in words:
            i = get(w)
            if i is not None:
                known.append(i)
                continue
            v = self.unseen.get(w)
            if v is None:
                if len(self.unseen) >= REMEMBERED:
                    self.unseen.clear()
                v = self.unseen[w] = self.backoff(w)
            total += v
        if known:
            total += self.table[known].sum(axis=0, dtype=np.float64)
        p = np.exp(total - total.max())
        best = int(p.argmax())  # the first of equals, in order of name
        return self.langs[best], float(p[best] / p.sum())


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score (posterior, 0 to 1) of every whole text; "und" and 0 for null texts and texts without letters.

    Only text is read, and whole.  Equal posteriors go to the language that is first by name.  Repeated rows give repeated
    rows, an empty table an empty result; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            got = [scorer.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
