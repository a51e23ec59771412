"""Readers and writers: manifests, images, memory banks, run reports."""

from __future__ import annotations

import csv
import os
import re
import struct
import tempfile
import threading
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("image_path", "label", "split", "source", "ood_type")
#: Nested report of one run.
REPORT = """global struct<auroc: double, auprc: double, fpr_at_95_tpr: double>, confusion_matrix struct<tn: long, fp: long, fn: long, tp: long>,
threshold struct<value: double, source: string, quantile: double>, counts struct<total: long, id: long, ood: long>,
per_ood_type map<string, struct<auroc: double, auprc: double, fpr_at_95_tpr: double, id_count: long, ood_count: long>>"""
CONFIG = "project struct<run_name: string>, model struct<name: string, backbone: string, layers: string>"
#: Names a configuration can have beside a report, in order of precedence; "../" is the folder above.
CONFIG_NAMES = ("resolved_evaluation_config.json", "resolved_config.json", "../resolved_config.json")


class SourceError(ValueError):
    """A source that can't be read as what it should be."""


_handed_out = threading.local()


@contextmanager
def tidy(spark: SparkSession):
    """Delete, when the block ends, all that scratch() handed out to this thread in it: for work whose results are written or taken by then.

    The block gets a function that takes a table of stored() and gives it back, to be kept for as long as the scope around
    this one, if there is one, lasts.
    """
    outer, _handed_out.paths = getattr(_handed_out, "paths", None), []

    def keep(table: DataFrame) -> DataFrame:
        _handed_out.paths.remove(table._stored_at)
        if outer is not None:
            outer.append(table._stored_at)
        return table

    try:
        yield keep
    finally:
        for path in _handed_out.paths:
            _deleted(spark, path)
        _handed_out.paths = outer


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; a folder of our own only where the session names none and runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise SourceError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="oodspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/oodspark-{name}-{uuid.uuid4().hex}"
    if getattr(_handed_out, "paths", None) is not None:
        _handed_out.paths.append(path)
    return path


#: Spark's own setting: the shuffle files of an execution go when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _cleaning = threading.Lock(), {}


@contextmanager
def _held(spark: SparkSession, key: str, value: str):
    """The setting holds while any thread is in the block, and is what it was before once the last one leaves."""
    at = (id(spark), key)
    with _lock:
        count, before = _cleaning.get(at, (0, None))
        if not count:
            before = spark.conf.get(key)
            spark.conf.set(key, value)
        _cleaning[at] = (count + 1, before)
    try:
        yield
    finally:
        with _lock:
            count, before = _cleaning[at]
            _cleaning[at] = (count - 1, before)
            if count == 1:
                spark.conf.set(key, before)


def _cleaned(spark: SparkSession):
    return _held(spark, CLEANED, "true")


@contextmanager
def listed(spark: SparkSession):
    """In the block, folders are listed by a few tasks for each core; Spark's own choice is a task for each folder, up to 10,000.

    Of a file no more is kept on the driver than the reader needs, and no longer: neither where its blocks lie nor, for
    later reads, that it is there.
    """
    few = str(4 * spark.sparkContext.defaultParallelism)
    with _held(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", few), _held(spark, "spark.sql.sources.ignoreDataLocality", "true"), _held(spark, "spark.sql.hive.filesourcePartitionFileCacheSize", "0"):
        yield


@contextmanager
def small_files(spark: SparkSession):
    """In the block, reading many small files costs less.

    Opening a file counts as reading 32 KB, so a task gets hundreds of them; Spark's own choice is 4 MB.  And rows are put
    together without generated code, as the image reader would generate it for each file, which takes longer than all else;
    nor are repeated expressions looked for then, as that costs more than they do.
    """
    with _held(spark, "spark.sql.files.openCostInBytes", "32k"), _held(spark, "spark.sql.codegen.factoryMode", "NO_CODEGEN"), _held(spark, "spark.sql.subexpressionElimination.enabled", "false"):
        yield


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def released(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        _deleted(df.sparkSession, df._stored_at)


def export_csv(df: DataFrame, path: str) -> None:
    """Write df as CSV: every value quoted, quotes doubled, nulls empty; readers see the old table or the whole new one.

    The table is written beside its place and then renamed, so a job that fails leaves path as it was.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.csv(beside, header=True, quoteAll=True, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    _deleted(spark, path)
    if not files.rename(place(beside), place(path)):
        raise SourceError(f"{beside} could not be renamed to {path}")


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of export_csv(); an empty text comes back as null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', emptyValue=None, mode="FAILFAST")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 1 in its file) and text of the records of CSV files, which may be cut to splits anywhere.

    A line begins a record if the quotes before it in its file are even in number.  Each split counts its quotes, and the
    lines that begin records, for either parity that it may start with.  Sums over the splits of a file tell which it is and
    how many records come before.  Only records of several lines are then put together by a shuffle.  Blank
    lines between records are none; a quote that is never closed is an error.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    upto = Window.partitionBy("file", "split").orderBy("at")  # the lines of one split
    lines = lines.withColumn("odd", (F.sum("quotes").over(upto) - F.col("quotes")) % 2)
    begun = lambda odd: F.sum(((F.col("odd") == odd) & (F.col("line") != "")).cast("long"))
    lines = stored(lines.withColumns({"even_start": begun(0).over(upto), "odd_start": begun(1).over(upto)}), "csv-lines")
    splits = lines.groupBy("file", "split").agg((F.sum("quotes") % 2).alias("turns"), F.max("even_start").alias("n0"), F.max("odd_start").alias("n1"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.withColumn("start", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    splits = splits.withColumn("ahead", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))).over(before), F.lit(0)))
    splits = stored(splits, "csv-splits")
    open_ = splits.groupBy("file").agg((F.sum("turns") % 2).alias("left")).filter("left = 1").first()
    if open_:
        raise SourceError(f"a quote is never closed: {open_['file']}")
    rows = lines.join(splits.select("file", "split", "start", "ahead"), ["file", "split"])
    inside = F.col("odd") != F.col("start")
    rows = rows.withColumn("record", F.col("ahead") + F.when(F.col("start") == 0, F.col("even_start")).otherwise(F.col("odd_start"))).withColumn("inside", inside)
    whole = rows.filter("NOT inside AND quotes % 2 = 0 AND line <> ''").select("file", "record", F.col("line").alias("text"))
    parts = rows.filter("inside OR quotes % 2 = 1").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("parts"))  # the lines of one record
    return whole.union(parts.select("file", "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n")))


def read_manifest(spark: SparkSession, path: str, line_numbers: bool = False) -> DataFrame:
    """A manifest with a header line, any column order and extra columns, all as text; a file without any line is an error.

    Large files are read by many tasks, though their fields may hold line breaks.  line_numbers adds csv_row, the number of a
    record in its file with the header as 1.  Files of one manifest may order their columns differently.
    """
    records = csv_records(spark, path)
    heads = records.filter("record = 1").groupBy("text").agg(F.count("*").alias("files")).collect()  # a row for each kind of header
    if not heads:
        raise SourceError(f"manifest is empty: {path}")
    out = None
    for head in heads:
        names = next(csv.reader([head["text"]]))
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        rows = records.filter("record > 1")
        if len(heads) > 1:
            rows = rows.join(records.filter((F.col("record") == 1) & (F.col("text") == head["text"])).select("file"), "file", "left_semi")
        rows = rows.select(F.from_csv("text", F.lit(schema), {"escape": '"'}).alias("_r"), "record")
        rows = rows.select("_r.*", F.col("record").alias("csv_row")) if line_numbers else rows.select("_r.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def png(image: np.ndarray) -> bytes:
    """A height x width x 3 image of bytes as a PNG file."""
    height, width = image.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), dtype=np.uint8), image.reshape(height, -1)], axis=1)  # each line unfiltered
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def _local(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if it lies in a file system that is mounted; None in any other."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.makeQualified(place).toUri().getPath() if files.getUri().getScheme() == "file" else None


#: What Spark's writer escapes in names of folders.
ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


#: Folders of files that stand side by side.
SIDE_BY_SIDE = 64


def write_files(files: DataFrame, path: str, flat: bool = False) -> None:
    """Write each row of files (name, data) as a file of its own below path/name=...; names must tell rows apart.

    flat: in a mounted file system name=... is the file and not a folder around it, in a few folders by hash of the name, so that
    there is less to make and to list.  Tasks that are lost are written again and no half file stays.  In a mounted file system the tasks write the files and rename
    them one by one, as the steps of Spark's writer cost many times that for a small file; elsewhere it is Spark's writer.  A line
    feed follows the data, which image and JSON readers pass over; without it Spark would not read empty files.
    """
    root = _local(files.sparkSession, path)
    if root is None:
        files.select("name", F.col("data").cast("string").alias("data")).write.partitionBy("name").text(path)
        return
    if os.path.exists(root):
        raise SourceError(f"{path} exists")

    def put(batches):
        there = set()
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                file = "name=" + ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name.as_py())
                folder, file = (f"{root}/{zlib.crc32(file.encode()) % SIDE_BY_SIDE}", file) if flat else (f"{root}/{file}", "part-0.txt")
                if folder not in there:
                    os.makedirs(folder, exist_ok=True)
                    if flat:
                        there.add(folder)
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with open(beside, "wb") as f:
                    f.write(data.as_py() + b"\n")
                os.replace(beside, f"{folder}/{file}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    os.makedirs(root)
    files.select("name", "data").mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def write_images(images: DataFrame, path: str, flat: bool = False) -> None:
    """Write 8-bit images (image_id, height, width, channels (3), pixels) as PNG files that read_images() reads, made in the tasks that hold them."""

    def encode(batches):
        for b in batches:
            values, starts = b.column("pixels").values.to_numpy(zero_copy_only=False), b.column("pixels").offsets.to_numpy()
            shapes = list(zip(b.column("height").to_pylist(), b.column("width").to_pylist(), strict=True))
            for start in range(0, b.num_rows, 16):  # images at a time
                made = [png(values[starts[i] : starts[i + 1]].astype(np.float64).astype(np.uint8).reshape(3, *shapes[i]).transpose(1, 2, 0)) for i in range(start, min(start + 16, b.num_rows))]
                yield pa.RecordBatch.from_arrays([b.column("name").slice(start, 16), pa.array(made, pa.binary())], names=["name", "data"])

    write_files(images.select(F.col("image_id").cast("string").alias("name"), "height", "width", "pixels").mapInArrow(encode, "name string, data binary"), path, flat)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_path, height, width, channels (3), pixels (channel by channel, rows, columns; red first) and error of image files.

    Files that can't be decoded stay, with an error.  Grey images get three equal channels.
    """
    with listed(spark):
        files = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return decoded(files)


#: What the image reader gives, for streams.
IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def decoded(files: DataFrame, length: str | None = None) -> DataFrame:
    """read_images() of a table or stream that the image reader gives, with a column of its lengths, if there is one."""
    more = [length] if length else []
    df = files.select("image.*", *more)

    def channels(batches):
        for b in batches:
            for start in range(0, b.num_rows, 16):  # images at a time
                part = b.slice(start, 16)
                rows, pixels = part.to_pylist(), []
                for r in rows:
                    if r["height"] > 0:
                        planes = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], r["nChannels"])[..., 2::-1]  # blue first, transparency last
                        pixels.append(np.broadcast_to(planes, (*planes.shape[:2], 3)).transpose(2, 0, 1).ravel().astype(np.float32))
                    else:
                        pixels.append(None)
                bad = [x is None for x in pixels]
                columns = [part.column(0), part.column(1), part.column(2), pa.array([None if x else 3 for x in bad], pa.int32()), pa.array(pixels, pa.list_(pa.float32())), pa.array(["not a supported image" if x else None for x in bad], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + part.columns[5:], names=["image_path", "height", "width", "channels", "pixels", "error", *more])

    rows = df.select(F.col("origin").alias("image_path"), "height", "width", "nChannels", "data", *[F.col(c).cast("long").alias(c) for c in more])
    return rows.mapInArrow(channels, "image_path string, height int, width int, channels int, pixels array<float>, error string" + "".join(f", {c} long" for c in more))


#: Files of a run: its report, and the configurations.
RUN_FILES = ("metrics.json", *{n.split("/")[-1]: None for n in CONFIG_NAMES})


def write_runs(files: DataFrame, runs_dir: str) -> None:
    """Write files (run_dir, file, text) of many runs at once, as runs_dir/run_dir=.../file=.../part-...; run_dir may have folders of its own."""
    files.select("run_dir", "file", "text").write.partitionBy("run_dir", "file").text(runs_dir)


def read_reports(spark: SparkSession, runs_dir: str) -> DataFrame:
    """metrics_path, the report columns and config of every metrics.json below runs_dir, however deep.

    Folders that write_runs() made count as the files they stand for.  The first configuration that exists of CONFIG_NAMES
    is taken as a whole.  Without any report, or with one that is no JSON object, the call fails.
    """
    files = spark.read.text(runs_dir, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{" + ",".join([*RUN_FILES, "part-*.txt"]) + "}")
    path = F.regexp_replace(F.col("_metadata.file_path"), "/file=([^/]*)/part-[^/]*$", "/$1")
    parted = F.regexp_extract(path, "^(.*)/run_dir=([^/]*)/([^/]*)$", 2)
    path = F.when(parted != "", F.concat(F.regexp_extract(path, "^(.*)/run_dir=", 1), F.lit("/"), F.url_decode(F.url_decode(parted)), F.lit("/"), F.regexp_extract(path, "([^/]*)$", 1))).otherwise(path)
    files = files.select(path.alias("_path"), F.col("value").alias("_text"))
    files = files.select("_path", "_text", F.regexp_extract("_path", "^(.*)/[^/]*$", 1).alias("_dir"), F.regexp_extract("_path", "([^/]*)$", 1).alias("_name"))
    found = files.filter("_name = 'metrics.json'").select(F.col("_path").alias("metrics_path"), "_dir", F.from_json("_text", REPORT.replace("\n", " "), {"mode": "FAILFAST"}).alias("_j"))
    if found.isEmpty():
        raise SourceError(f"no metrics.json below {runs_dir}")
    # each configuration goes to the folders it may serve, with its rank there
    up = F.regexp_replace(F.col("_dir"), "/[^/]*$", "")
    ranks = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n.split("/")[-1]).alias("name"), F.lit(n.startswith("../")).alias("above")) for i, n in enumerate(CONFIG_NAMES)])
    configs = files.filter(F.col("_name") != "metrics.json").withColumn("_r", F.explode(F.filter(ranks, lambda r: r["name"] == F.col("_name"))))
    reports = found.select("metrics_path", F.explode(F.array(F.struct(F.col("_dir").alias("at"), F.lit(False).alias("above")), F.struct(up.alias("at"), F.lit(True).alias("above")))).alias("_o"))
    served = reports.join(configs, (F.col("_o.at") == F.col("_dir")) & (F.col("_o.above") == F.col("_r.above")))
    best = served.groupBy("metrics_path").agg(F.min_by(F.from_json("_text", CONFIG, {"mode": "FAILFAST"}), F.col("_r.rank")).alias("config"))
    return found.join(best, "metrics_path", "left").select("metrics_path", "_j.*", "config")


def write_report(report: DataFrame, path: str, by: str | None = None) -> None:
    w = report.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def save_bank(bank: DataFrame, meta: dict, path: str) -> None:
    """bank_id and embedding, and a one-row table of how the bank was made; an empty bank is an error."""
    if bank.isEmpty():
        raise SourceError("there is no memory bank to save")
    bank.select("bank_id", "embedding").write.mode("overwrite").parquet(f"{path}/bank")
    schema = "backbone string, layers array<string>, coreset_ratio double, k int, max_patches long, seed int"
    row = [(meta.get("backbone"), meta.get("layers"), meta.get("coreset_ratio", 0.1), meta.get("k", 1), meta.get("max_patches"), meta.get("seed", 42))]
    bank.sparkSession.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{path}/meta")


def load_bank(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/bank"), spark.read.parquet(f"{path}/meta").first().asDict()
