"""Manifest checks, projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import CORRUPTIONS
from ..sources import REQUIRED, stored

LABELS, SPLITS = (0.0, 1.0), ("train", "val", "test")
#: Texts that count as missing, as the usual CSV readers have them.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A")
#: Kinds of violation, in the order in which they are raised.
KINDS = ("image_path", "label", "split")


class ManifestError(ValueError):
    """A manifest that breaks its rules."""


def require_columns(df: DataFrame, required=REQUIRED) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ManifestError(f"manifest lacks columns: {', '.join(missing)}")


def flagged(raw: DataFrame) -> DataFrame:
    """raw (all text) with bad_image_path, bad_label and bad_split."""
    path, label = F.trim("image_path"), F.expr("try_cast(trim(label) AS double)")
    return raw.withColumns({
        "bad_image_path": path.isNull() | path.isin(*MISSING),
        "bad_label": ~F.coalesce(label.isin(*LABELS), F.lit(False)),
        "bad_split": ~F.coalesce(F.trim("split").isin(*SPLITS), F.lit(False)),
    })


def violations(raw: DataFrame) -> DataFrame:
    """kind and n_rows for each kind of violation, in one pass; kind "empty" has 1 if there are no rows."""
    row = flagged(raw).agg(F.count("*").alias("n"), *[F.count_if(f"bad_{k}").alias(k) for k in KINDS])
    kinds = F.array(F.struct(F.lit("empty").alias("kind"), (F.col("n") == 0).cast("long").alias("n_rows")), *[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("n_rows")) for k in KINDS])
    return row.select(F.inline(kinds))


def cleaned(raw: DataFrame) -> DataFrame:
    """raw with trimmed paths and splits and labels as integers."""
    return raw.withColumns({"image_path": F.trim("image_path"), "label": F.expr("try_cast(trim(label) AS double)").cast("int"), "split": F.trim("split")})


def validated(raw: DataFrame, listing: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """cleaned(raw) if raw keeps all rules; else ManifestError of the first that it breaks, with up to five examples or, with csv_row, rows."""
    require_columns(raw)
    found = {r["kind"]: r["n_rows"] for r in violations(raw).collect()}
    if found["empty"]:
        raise ManifestError("manifest has no rows")
    for kind in KINDS:
        if found[kind]:
            rows = flagged(raw).filter(f"bad_{kind}")
            if "csv_row" in raw.columns:
                lines = [r["csv_row"] for r in rows.orderBy("csv_row").select("csv_row").limit(5).collect()]
                raise ManifestError(f"{found[kind]} rows with a bad {kind}, at CSV rows {lines}")
            examples = [r[kind] for r in rows.select(kind).limit(5).collect()]
            raise ManifestError(f"{found[kind]} rows with a bad {kind}: {examples}")
    out = cleaned(raw)
    if listing is not None:
        gone = missing_files(resolved(out, root), listing)
        n = gone.count()
        if n:
            raise ManifestError(f"{n} files are missing: {[r[0] for r in gone.select('resolved_image_path').limit(5).collect()]}")
    return out


def resolved(df: DataFrame, root: str | None) -> DataFrame:
    """df with resolved_image_path: absolute paths as they are, others below root."""
    path = F.col("image_path")
    full = path if root is None else F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    return df.withColumn("resolved_image_path", full)


def missing_files(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of resolved() whose file isn't in listing (column path)."""
    return df.join(listing.select(F.col("path").alias("resolved_image_path")), "resolved_image_path", "left_anti")


def id_subset(df: DataFrame) -> DataFrame:
    """Rows of label 0; all rows if there is no label column."""
    return df.filter("label = 0") if "label" in df.columns else df


def safe_stem(path: Column, default: str = "image") -> Column:
    """File name without its last suffix, other than letters, digits, _ . - replaced by _."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(F.trim(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")), r"[^A-Za-z0-9_.-]+", "_")
    return F.when(stem == "", default).otherwise(stem)


def relative_to(path: Column, root: str) -> Column:
    """path below root as a relative path; others unchanged."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def artifact_manifest(df: DataFrame, out_dir: str, root: str, kinds=tuple(CORRUPTIONS), split: str = "test", limit: int | None = None, order=("image_path",)) -> DataFrame:
    """A row for each label-0 row (the first limit in the given order) and kind of corruption, as the manifest of the files to be made."""
    if split not in SPLITS:
        raise ManifestError(f"unknown split {split!r}")
    if limit is not None and limit <= 0:
        raise ManifestError("limit must be positive")
    if not kinds or set(kinds) - set(CORRUPTIONS):
        raise ManifestError(f"kinds must be some of {', '.join(CORRUPTIONS)}")
    rows = id_subset(df)
    # positions by counting what lies in earlier ranges of the order, not in one task
    rows = rows.orderBy(*order).limit(limit) if limit else rows
    rows = numbered(rows, order)
    rows = rows.withColumn("_stem", safe_stem(F.col("image_path"))).withColumn("_kind", F.explode(F.array(*map(F.lit, kinds))))
    file = F.concat(F.lit(out_dir.rstrip("/") + "/"), F.format_string("%05d_%s_%s.png", "row_idx", "_stem", "_kind"))
    scanner = F.coalesce(F.col("scanner").cast("string"), F.lit("")) if "scanner" in df.columns else F.lit("")
    return rows.select(relative_to(file, root).alias("image_path"), F.lit(1).alias("label"), F.lit(split).alias("split"), F.lit("synthetic_artifact").alias("source"), F.lit("sensory_artifact").alias("ood_type"), F.lit("").alias("patient_id"), scanner.alias("scanner"), F.concat("_kind", F.lit(" generated from held-out valid image")).alias("notes"))


def numbered(df: DataFrame, order, name: str = "row_idx") -> DataFrame:
    """df with a running number from 0 in the given order, which should tell rows apart.

    Rows are dealt to ranges of the order, sorted there and written once to the shared folder with their range and place in
    it; the numbers of rows in earlier ranges, a row for each range, give the rest.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "numbered").withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + place).drop("_part", "_at", "_ahead")


def composition(df: DataFrame, keys=("split", "label", "source", "ood_type")) -> DataFrame:
    """Rows per combination of the keys and all their roll-ups; "ALL" marks what is summed over."""
    total = [F.when(F.grouping(k) == 1, "ALL").otherwise(F.col(k).cast("string")).alias(k) for k in keys]
    return df.rollup(*keys).agg(F.count("*").alias("n_rows"), *[t.alias(f"_{k}") for t, k in zip(total, keys, strict=True)]).select(*[F.col(f"_{k}").alias(k) for k in keys], "n_rows")


def leaking_patients(df: DataFrame) -> DataFrame:
    """Patients (not null or blank) with rows in both train and test, and their numbers of rows there."""
    has = F.trim(F.col("patient_id").cast("string")) != ""
    rows = df.filter(has).groupBy("patient_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    return rows.filter("n_train > 0 AND n_test > 0")


def leaking_originals(df: DataFrame, artifacts: DataFrame) -> DataFrame:
    """artifacts (original_path, split) whose original has another role in df, or is a training row."""
    own = df.select(F.col("image_path").alias("original_path"), F.col("split").alias("original_split")).distinct()
    return artifacts.join(own, "original_path").filter((F.col("original_split") != F.col("split")) | (F.col("original_split") == "train"))
