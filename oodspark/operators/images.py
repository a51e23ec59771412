"""Image tables: resizing, grey conversion, scaling, corruption.

An image is a row (image_id, height, width, channels, pixels), pixels by channel, row and column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

#: Channel means and deviations of the usual pretrained networks.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Images that a task takes out of a batch together.
TOGETHER = 64
SCHEMA = "image_id long, height int, width int, channels int, pixels array<float>"


def resized(images: DataFrame, size: int = 224, antialias: bool = True) -> DataFrame:
    """Images brought to size x size by bilinear interpolation, whatever their proportions."""
    if size <= 0:
        raise ValueError("size must be positive")

    def run(batches):
        for b in batches:
            got = [kernels.resize(np.asarray(p, dtype=np.float64).reshape(c, h, w), size, size, antialias).ravel().astype(np.float32) for p, c, h, w in zip(b["pixels"], b["channels"], b["height"], b["width"], strict=True)]
            yield pd.DataFrame({"image_id": b["image_id"], "height": size, "width": size, "channels": b["channels"], "pixels": got})

    return images.select("image_id", "height", "width", "channels", "pixels").mapInPandas(run, SCHEMA)


def grey(images: DataFrame) -> DataFrame:
    """Three equal channels of the integer luma of 8-bit pixels."""
    n = F.col("height") * F.col("width")
    part = lambda i: F.slice("pixels", i * n + 1, n)
    luma = F.transform(F.arrays_zip(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")), lambda p: F.shiftright(19595 * p["r"].cast("int") + 38470 * p["g"].cast("int") + 7471 * p["b"].cast("int") + 32768, 16).cast("float"))
    return images.withColumn("_l", luma).withColumn("pixels", F.concat("_l", "_l", "_l")).drop("_l")


def scaled(images: DataFrame) -> DataFrame:
    return images.withColumn("pixels", F.transform("pixels", lambda x: (x.cast("double") / 255.0)))


def normalised(images: DataFrame, how: str = "imagenet") -> DataFrame:
    """Scaled pixels less the mean of their channel over its deviation; "minmax" and "none" change nothing."""
    if how in ("minmax", "none"):
        return images
    if how != "imagenet":
        raise ValueError(f"unknown normalisation {how!r}")
    n, mean, std = F.col("height") * F.col("width"), F.array(*map(F.lit, MEAN)), F.array(*map(F.lit, STD))
    channel = lambda i: F.floor(i / n).cast("int")
    return images.withColumn("pixels", F.transform("pixels", lambda x, i: (x - F.get(mean, channel(i))) / F.get(std, channel(i))))


def corrupted(images: DataFrame, kinds=tuple(kernels.CORRUPTIONS), seed: int = 42) -> DataFrame:
    """Each 8-bit image in each kind of corruption, with column kind.

    The random numbers of a row depend on seed, image and kind only, so neither order nor partitions matter.
    """
    unknown = set(kinds) - set(kernels.CORRUPTIONS)
    if unknown or not kinds:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    place = {k: i for i, k in enumerate(kernels.CORRUPTIONS)}

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, TOGETHER):
                part = b.slice(start, TOGETHER)
                about, got = part.select(["image_id", "height", "width", "kind"]).to_pylist(), []
                for r, p in zip(about, part.column("pixels"), strict=True):
                    image = p.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(3, r["height"], r["width"]).transpose(1, 2, 0).astype(np.uint8)
                    i = r["image_id"]
                    got.append(kernels.corrupted(image, r["kind"], [seed, i, i >> 32, place[r["kind"]]]).transpose(2, 0, 1).ravel().astype(np.float32))
                columns = [pa.array(got, pa.list_(pa.float32())) if name == "pixels" else part.column(name) for name in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["image_id", "height", "width", "channels", "pixels", "kind"]
    rows = images.select("image_id", "height", "width", "channels", "pixels", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return rows.mapInArrow(run, SCHEMA + ", kind string")
