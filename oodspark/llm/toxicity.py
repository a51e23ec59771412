"""Toxicity score: logistic regression on hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features are a text's distinct words, neighbouring pairs and pairs with one word between, hashed to a fixed number of
slots.  FTRL-proximal keeps a learning rate for each slot and, by its L1 term, weights that are mostly zero.  A sample of
the labelled rows, of bounded size, streams through one learner in an order of hashes, in a job for each epoch that takes
up the state of the one before; the result is a small sparse vector.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drawn, held_out, stored

SLOTS = 1 << 20
#: The fit reads about so many different labelled documents at most, chosen by hash of id and text.
FIT_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
THRESHOLD = 0.3
REMEMBERED = 300_000
WORD = re.compile(r"\w+")
#: Odd multipliers that tell words, pairs and skip pairs apart.
ONE, FIRST, SECOND, SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
SHIFT = np.uint64(64 - 20)


class Features:
    """Slots of a text, in ascending order and each once."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashed(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        h = self.known[word] = zlib.crc32(word.encode("utf-8", "replace")) + 1
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        get, hashed = self.known.get, self.hashed
        h = np.array([get(w) or hashed(w) for w in words], dtype=np.uint64)
        parts = [h * ONE, h[:-1] * FIRST + h[1:] * SECOND, h[:-2] * SKIP + h[2:] * FIRST] if len(h) else [h]
        return np.unique((np.concatenate(parts) >> SHIFT).astype(np.int32))


class Learner:
    """FTRL-proximal: z and n of each slot, and of the bias as the last."""

    def __init__(self, at=(), z=(), n=()):
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
        if len(at):
            self.z[at], self.n[at] = z, n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0.0
        return w

    def learn(self, slots: np.ndarray, y: int) -> None:
        at = np.append(slots, SLOTS)
        w, n = self.weights(at), self.n[at]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, epochs: int = EPOCHS) -> dict:
    """Sparse weights from the labelled documents that are not held out; a null label labels nothing, and any 1 among repeated labels counts.

    Rows equal in id and text are one.  Training order is a hash of id and text, so reruns agree.  The rows that are learnt
    from, not more than rows bounds, pass through one task in batches; it holds no more than the model.  No labelled
    document gives zero weights, that is a score of 0.5.
    """
    told = labels.select("doc_id", F.col("toxic").cast("int").alias("_y")).filter(F.col("_y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    own = docs.select(F.col("doc_id"), "text", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit("toxicity")).alias("_o"))
    found = stored(own.select("doc_id", "_o").join(told, "doc_id").distinct(), "toxicity-rows")
    chosen = found.filter(drawn(F.col("_o"), rows, found.count())).select("_o", "_y")

    def slots(batches):
        features = Features()
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                found = [features(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["_o", "_y", "at"])

    # about so many rows as asked for at most, so their keys may be sent to all
    sliced = own.join(F.broadcast(chosen), "_o").select("_o", "_y", "text").mapInArrow(slots, "_o long, _y int, at array<int>").dropDuplicates(["_o"])
    ordered = stored(sliced, "toxicity-slots").coalesce(1).sortWithinPartitions("_o").select("_y", "at")

    def epoch(state):
        def learnt(batches):
            learner = Learner(*state.value)
            for b in batches:
                for y, at in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    learner.learn(at.values.to_numpy(), y)
            at = np.flatnonzero(learner.n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(learner.z[at]), pa.array(learner.n[at])], names=["at", "z", "n"])

        return learnt

    state: tuple = ((), (), ())
    for _ in range(epochs):
        sent = docs.sparkSession.sparkContext.broadcast(state)  # three columns of SLOTS + 1 rows at most
        got = ordered.mapInArrow(epoch(sent), "at long, z double, n double").toArrow()
        state = tuple(got[c].to_numpy() for c in ("at", "z", "n"))
    w = Learner(*state).weights(np.arange(SLOTS + 1))
    at = np.flatnonzero(w[:-1])
    return {"at": at, "w": w[at].astype(np.float32), "bias": float(w[-1])}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every whole text; a null or empty text has the score of the bias alone.

    Only text is read, and whole.  Equal texts have equal scores.  Repeated rows give repeated rows, an empty table an empty
    result; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, features = sent.value, Features()
        w = np.zeros(SLOTS, dtype=np.float32)
        w[m["at"]] = m["w"]
        for b in batches:
            x = np.array([m["bias"] + w[features(t)].sum(dtype=np.float64) for t in b["text"]], dtype=np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(x, -30, 30)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def op8_toxicity_ftrl(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity_ftrl": op8_toxicity_ftrl}
ORACLES: dict[str, str] = {}
