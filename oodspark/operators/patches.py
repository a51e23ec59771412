"""Patch tables, memory banks, nearest-neighbour scores and reconstruction baselines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import balls

LAYERS = ("layer1", "layer2", "layer3", "layer4")
#: A bank of up to so many bytes is sent to the executors; a larger one stays a table.
BROADCAST_BYTES = 256 << 20
#: Most rows of all pairs that a task makes together, points whose rows stand side by side in them, and aim for the rows of a task.
PAIRS, SIDE, TASK_PAIRS = 65_536, 64, 1 << 26

#: Values of the patches of images that are compared together, about.
HELD_VALUES = 1 << 18


class BankError(ValueError):
    """A memory bank that can't be made or used."""


def extracted(images: DataFrame, extractor: Callable[[np.ndarray], dict[str, np.ndarray]], layers: Sequence[str]) -> DataFrame:
    """Feature maps (image_id, layer, c, h, w, values) of images, by a function from a (1, 3, h, w) array to arrays by layer."""
    if not layers or set(layers) - set(LAYERS):
        raise ValueError(f"layers must be some of {', '.join(LAYERS)}")

    def run(batches):
        for b in batches:
            out = []
            for i, h, w, c, p in zip(b["image_id"], b["height"], b["width"], b["channels"], b["pixels"], strict=True):
                maps = extractor(np.asarray(p, dtype=np.float32).reshape(1, c, h, w))
                out += [(i, name, *maps[name].shape[1:], maps[name].ravel().astype(np.float32)) for name in layers]
            yield pd.DataFrame(out, columns=["image_id", "layer", "c", "h", "w", "values"])

    return images.select("image_id", "height", "width", "channels", "pixels").mapInPandas(run, "image_id long, layer string, c int, h int, w int, values array<float>")


def mean_grid(image: np.ndarray) -> dict[str, np.ndarray]:
    """A trivial extractor: channel means of 2 x 2 cells."""
    b, c, h, w = image.shape
    cells = image[:, :, : h // 2 * 2, : w // 2 * 2].reshape(b, c, h // 2, 2, w // 2, 2).mean(axis=(3, 5))
    return {"layer1": cells, "layer2": cells.mean(axis=1, keepdims=True)}


def file_scores(images: DataFrame, extractor: Callable[[np.ndarray], dict[str, np.ndarray]], layer: str, bank: np.ndarray, k: int = 1) -> DataFrame:
    """images (filename, length, height, width, channels, pixels, error) as filename, length and score, for tables and streams alike.

    The score is that of the farthest patch of one layer, by the mean of its k smallest distances to the bank, an array
    that is sent to the tasks (see BROADCAST_BYTES).  No image needs another, so a stream keeps no state.  Images that were
    not decoded have no score.
    """
    if bank.nbytes > BROADCAST_BYTES or not 0 < k <= len(bank):
        raise BankError("the bank must be small enough to be sent and hold k rows")

    def scored(waiting: list[tuple[int, np.ndarray]], out: list) -> None:
        """Puts the scores of images, given as place and patches; equal patches are compared once."""
        points = np.ascontiguousarray(np.concatenate([x for _, x in waiting]))
        _, at, back = np.unique(points.view(f"V{points.itemsize * points.shape[1]}")[:, 0], return_index=True, return_inverse=True)
        far = kernels.smallest_distances(points[at], bank, k).mean(axis=1)[back]
        starts = np.cumsum([0] + [len(x) for _, x in waiting[:-1]])
        for (i, _), score in zip(waiting, np.maximum.reduceat(far, starts), strict=True):
            out[i] = float(score)

    def run(batches):
        for b in batches:
            pixels, out, waiting, held = b.column("pixels"), [None] * b.num_rows, [], 0
            values, starts = pixels.values.to_numpy(zero_copy_only=False), pixels.offsets.to_numpy()
            for i, (h, w, c, there) in enumerate(zip(*(b.column(x).to_pylist() for x in ("height", "width", "channels")), pixels.is_valid().to_pylist(), strict=True)):
                if not there:
                    continue
                grid = extractor(values[starts[i] : starts[i + 1]].astype(np.float32).reshape(1, c, h, w))[layer][0]
                points = grid.reshape(len(grid), -1).T.astype(np.float64)
                if not len(points):
                    raise ValueError(f"an image of {h} by {w} has no patches")
                waiting.append((i, points))
                held += points.size
                if held >= HELD_VALUES:
                    scored(waiting, out)
                    waiting, held = [], 0
            if waiting:
                scored(waiting, out)
            yield pa.RecordBatch.from_arrays([b.column("filename"), b.column("length"), pa.array(out, pa.float64())], names=["filename", "length", "score"])

    return images.select("filename", F.col("length").cast("long").alias("length"), "height", "width", "channels", "pixels").mapInArrow(run, "filename string, length long, score double")


def embedded(features: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Patches (image_id, patch_row, patch_col, embedding): all layers brought to the grid of the first and joined by channel."""
    if not layers:
        raise ValueError("no layers")
    wanted = features.filter(F.col("layer").isin(*layers))
    maps = wanted.groupBy("image_id").agg(*[F.first(F.when(F.col("layer") == name, F.struct("c", "h", "w", "values")), ignorenulls=True).alias(f"_{i}") for i, name in enumerate(layers)])

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if any(x is None for x in r[1:]):
                    raise ValueError(f"image {r[0]} lacks a layer")
                arrays = [np.asarray(m["values"], dtype=np.float64).reshape(m["c"], m["h"], m["w"]) for m in r[1:]]
                h, w = arrays[0].shape[1:]
                joined = np.concatenate([a if a.shape[1:] == (h, w) else kernels.resize(a, h, w) for a in arrays])
                out += [(r[0], y, x, joined[:, y, x]) for y in range(h) for x in range(w)]
            yield pd.DataFrame(out, columns=["image_id", "patch_row", "patch_col", "embedding"])

    return maps.mapInPandas(run, "image_id long, patch_row int, patch_col int, embedding array<double>")


def exploded(features: DataFrame) -> DataFrame:
    """Patches of feature maps of one layer, in columns only."""
    rows = features.select("image_id", "c", "h", "w", "values", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    vector = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda c: F.get("values", c * F.col("h") * F.col("w") + F.col("i")).cast("double"))
    return rows.select("image_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("patch_row"), (F.col("i") % F.col("w")).cast("int").alias("patch_col"), vector.alias("embedding"))


def hashed(patches: DataFrame, keys: Sequence[str], seed: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """patches with their hash _h, and how many have each of the 65,536 first four digits of it, in order."""
    rows = patches.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
    bins = rows.groupBy(F.substring("_h", 1, 4).alias("b")).count().collect()  # 65,536 rows at most
    return rows, sorted((r["b"], r["count"]) for r in bins)


def first_by_hash(rows: DataFrame, bins: list[tuple[str, int]], size: int, keys: Sequence[str]) -> DataFrame:
    """The size rows of hashed() of the smallest hash: a filter on whole bins, and of the bin with the cut its first rows."""
    before = 0
    for start, n in bins:
        if before + n >= size:
            break
        before += n
    head = F.substring("_h", 1, 4)
    if before + n == size:
        return rows.filter(head <= start)
    return rows.filter(head < start).union(rows.filter(head == start).orderBy("_h", *keys).limit(size - before))


def coreset(patches: DataFrame, keys: Sequence[str], ratio: float = 0.1, most: int | None = None, seed: int = 42) -> DataFrame:
    """A random part of exactly min(ceil(n * ratio), most) patches, one at least: those of the smallest hash of seed and key."""
    if not 0 < ratio <= 1 or most is not None and most <= 0:
        raise BankError("ratio must be above 0 and at most 1, and the cap positive")
    rows, bins = hashed(patches, keys, seed)
    n = sum(c for _, c in bins)
    if not n:
        raise BankError("no patches")
    return first_by_hash(rows, bins, max(1, min(int(np.ceil(n * ratio)), most or n, n)), keys).drop("_h")


def fitted_bank(patches: DataFrame, keys: Sequence[str], ratio: float = 0.1, most: int | None = None, seed: int = 42) -> DataFrame:
    """The coreset of the patches of label-0 images (of all patches if there is no label)."""
    rows = patches.filter("label = 0") if "label" in patches.columns else patches
    if rows.isEmpty():
        raise BankError("no in-distribution patches to fit on")
    return coreset(rows, keys, ratio, most, seed)


def bank_summary(patches: DataFrame, bank: DataFrame, ratio: float, most: int | None, k: int) -> DataFrame:
    a = patches.filter("label = 0").agg(F.count_distinct("image_id").alias("train_id_images"))
    b = bank.agg(F.count("*").alias("memory_bank_patches"), F.max(F.size("embedding")).alias("feature_dim"))
    return a.crossJoin(b).withColumns({"coreset_ratio": F.lit(ratio), "max_patches": F.lit(most).cast("long"), "k": F.lit(k)})  # one row each


def gathered(bank: DataFrame, rows: int, dims: int, *keys: str) -> tuple:
    """The vectors of so many bank rows as one array, and a key column of theirs; taken in Arrow batches, so nothing else of that size is held."""
    out, found, done = np.empty((rows, dims)), [], 0
    for b in bank.select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), *keys).toArrow().to_batches():
        out[done : done + b.num_rows] = kernels.stacked(b.column(0))
        found += b.columns[1:]
        done += b.num_rows
    if done != rows:
        raise BankError("the bank changed while it was read")
    return out, pa.concat_arrays(found) if keys else None


def spread(rows: DataFrame, least: int = 1) -> DataFrame:
    """rows dealt to all cores, in so many tasks at least: for work that is far more than their bytes tell."""
    return rows.repartition(max(least, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def knn_scores(patches: DataFrame, bank: DataFrame, k: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """patches with patch_score, the mean of the k smallest Euclidean distances to the bank, in double precision.

    A bank of proven small size is sent to the executors once.  A larger one is parted into balls and shells, and each patch
    meets those that the triangle inequality doesn't rule out.
    """
    shape = bank.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("most"), F.min(F.size("embedding")).alias("least")).first()
    if not shape["n"] or shape["most"] != shape["least"]:
        raise BankError("the bank must hold vectors of one length")
    if not 0 < k <= shape["n"]:
        raise BankError(f"k must be from 1 to {shape['n']}")
    others = [c for c in patches.columns if c != "embedding"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in patches.schema if f.name != "embedding")
    stack = lambda x: np.stack(x.to_numpy()).astype(np.float64)
    if shape["n"] * shape["most"] * 8 <= broadcast_bytes:
        sent = patches.sparkSession.sparkContext.broadcast(gathered(bank, shape["n"], shape["most"])[0])

        def near(batches):
            for b in batches:
                if len(b):
                    yield b[others].assign(patch_score=kernels.smallest_distances(stack(b["embedding"]), sent.value, k).mean(axis=1))

        return spread(patches).mapInPandas(near, f"{fields}, patch_score double")
    found, _ = balls.nearest(patches, bank, k, shape["n"])
    return found.select(*others, (F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / k).alias("patch_score"))


def knn_pairwise(patches: DataFrame, bank: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Distance of every patch to every bank row: patches without embedding, bank_id and distance.

    The result is as large as both numbers of rows multiplied.  Tasks make it from a bank of proven small size that is sent to
    them, PAIRS rows at a time; a larger bank is met by columns.  SIDE points meet a bank row together, so its id stands in runs
    and the points' columns recur, which column files hold in few bytes; a task makes a bounded part of the result.
    """
    shape = bank.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("most"), F.min(F.size("embedding")).alias("least")).first()
    if not shape["n"] or shape["most"] != shape["least"] or shape["n"] * shape["most"] * 8 > broadcast_bytes:
        squared = F.aggregate(F.zip_with("embedding", "bank_embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return patches.crossJoin(bank.select("bank_id", F.col("embedding").alias("bank_embedding"))).withColumn("distance", F.sqrt(squared)).drop("bank_embedding", "embedding")
    others = [f for f in patches.schema if f.name != "embedding"]
    sent = patches.sparkSession.sparkContext.broadcast(gathered(bank, shape["n"], shape["most"], "bank_id"))

    def run(batches):
        vectors, ids = sent.value
        for b in batches:
            kept = b.select([f.name for f in others])
            points = kernels.stacked(b.column("embedding"))
            for first in range(0, len(points), SIDE):
                side = points[first : first + SIDE]
                for start in range(0, len(ids), PAIRS // SIDE):
                    part = ids.slice(start, PAIRS // SIDE)
                    row, point = np.divmod(np.arange(len(part) * len(side)), len(side))
                    columns = [x.slice(first, SIDE).take(pa.array(point)) for x in kept.columns]
                    far = kernels.distances(vectors[start : start + len(part)], side)
                    yield pa.RecordBatch.from_arrays([*columns, part.take(pa.array(row)), pa.array(far.ravel())], names=[*kept.schema.names, "bank_id", "distance"])

    kind = bank.schema["bank_id"].dataType.simpleString()
    tasks = -(-shape["n"] * patches.count() // TASK_PAIRS)
    return spread(patches, tasks).mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], f"bank_id {kind}", "distance double"]))


def image_scores(scored: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The largest patch score of each image."""
    return scored.groupBy(*keys).agg(F.max("patch_score").alias("score"))


def pooled(patches: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One vector for each image: the mean of its patches."""
    means = patches.select(*keys, F.posexplode("embedding")).groupBy(*keys, "pos").agg(F.avg("col").alias("m"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"])
    return means.groupBy(*keys).agg(vector.alias("embedding"))


def reconstruction_error(df: DataFrame, x: str = "x", x_hat: str = "x_hat") -> DataFrame:
    """df with score, the mean squared difference of two vectors of one length; NULL if their lengths differ."""
    total = F.aggregate(F.zip_with(x, x_hat, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("score", F.when(F.size(x) == F.size(x_hat), total / F.size(x)))


def mean_baseline(patches: DataFrame, train: DataFrame) -> DataFrame:
    """Scores of a reconstruction by the mean vector of the label-0 training rows."""
    rows = train.filter("label = 0")
    if rows.isEmpty():
        raise BankError("no in-distribution rows to fit on")
    mean = pooled(rows.withColumn("_all", F.lit(0)), ("_all",)).select(F.col("embedding").alias("_hat"))
    return reconstruction_error(patches.crossJoin(F.broadcast(mean)), "embedding", "_hat").drop("_hat")  # one vector


def coreset_ranks(patches: DataFrame, keys: Sequence[str], ratios: Sequence[float], seed: int = 42) -> DataFrame:
    """For each ratio the nested coreset: ratio and the columns of patches.  No patches give no rows."""
    rows, bins = hashed(patches, keys, seed)
    n = sum(c for _, c in bins)
    out = patches.limit(0).select(F.lit(0.0).alias("ratio"), *patches.columns)
    for r in ratios if n else ():
        part = first_by_hash(rows, bins, max(1, min(n, int(np.ceil(n * r)))), keys)
        out = out.union(part.select(F.lit(float(r)).alias("ratio"), *patches.columns))
    return out
