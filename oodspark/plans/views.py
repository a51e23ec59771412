"""Views of the test tables as the inputs that the operators expect, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCORES = """SELECT event_id AS sample_index, 'images/' || event_type || '/' || CAST(event_id AS STRING) || '.png' AS image_path,
CAST(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS INT) AS label,
CASE event_type WHEN 'purchase' THEN 'modality_shift' WHEN 'error' THEN 'sensory_artifact' WHEN 'signup' THEN 'semantic_outlier' ELSE 'id' END AS ood_type,
round(value + CAST(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 25 END AS DOUBLE), 6) AS score, user_id AS patient_id, 'scanner_' || CAST(user_id % 3 AS STRING) AS scanner,
CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, 'run_' || CAST(CAST(JSON_K AS INT) % 5 AS STRING) AS run_name FROM {events}"""

BIG_SCORES = "SELECT l_extendedprice AS score, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS label, l_returnflag || l_linestatus AS ood_type FROM {lineitem}"

DOC_SCORES = """SELECT d.doc_id AS sample_index, CAST(d.n_chars AS DOUBLE) AS score, CAST(l.toxic AS INT) AS label, d.lang AS ood_type, d.source AS scanner
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

MANIFEST = """SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN '  ' WHEN doc_id % 3 = 0 THEN '/data/' || CAST(doc_id AS STRING) || '.png' ELSE ' img ' || CAST(doc_id AS STRING) || '.v1.png ' END AS image_path,
CASE WHEN doc_id % 89 = 0 THEN '2' WHEN doc_id % 83 = 0 THEN 'x' WHEN doc_id % 7 = 0 THEN '1.0' WHEN doc_id % 4 = 0 THEN '1' ELSE '0' END AS label,
CASE WHEN doc_id % 79 = 0 THEN 'dev' WHEN doc_id % 5 = 0 THEN ' test ' WHEN doc_id % 5 = 1 THEN 'val' ELSE 'train' END AS split, source,
CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'id' END AS ood_type, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'p' || CAST(doc_id % 211 AS STRING) END AS patient_id, 'scanner_' || CAST(doc_id % 3 AS STRING) AS scanner FROM {documents}"""

LISTING = """SELECT CASE WHEN doc_id % 3 = 0 THEN '/data/' || CAST(doc_id AS STRING) || '.png' ELSE '/root_dir/img ' || CAST(doc_id AS STRING) || '.v1.png' END AS path FROM {documents} WHERE doc_id % 11 <> 0"""

#: Labels are 0 to 9.  An image has 4 rows of one label; each label has 1,000 ids of every 10,000, so that no two images share one, however many rows there are.
_PATCHES = """SELECT vec_id, CAST(label AS BIGINT) * 1000 + CAST(floor(rn / 4000.0) AS BIGINT) * 10000 + CAST(floor((rn % 4000) / 4.0) AS BIGINT) AS image_id, CAST(floor((rn % 4) / 2.0) AS INT) AS patch_row, CAST(rn % 2 AS INT) AS patch_col,
CAST(CASE WHEN label >= 7 THEN 1 ELSE 0 END AS INT) AS label, CASE label WHEN 7 THEN 'kind_7' WHEN 8 THEN 'kind_8' WHEN 9 THEN 'kind_9' ELSE 'id' END AS ood_type,
CASE WHEN CAST(floor(rn / 4.0) AS BIGINT) % 5 < 3 THEN 'train' WHEN CAST(floor(rn / 4.0) AS BIGINT) % 5 = 3 THEN 'val' ELSE 'test' END AS role, SHIFTED AS embedding
FROM (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM {embeddings}) t"""
PATCHES = _PATCHES.replace("SHIFTED", "transform(embedding, x -> CAST(x AS DOUBLE) + CASE WHEN label >= 7 THEN CAST(0.04 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")
PATCHES_ORACLE = _PATCHES.replace("SHIFTED", "list_transform(embedding, lambda x: CAST(x AS DOUBLE) + CASE WHEN label >= 7 THEN CAST(0.04 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")

#: Grey 8 x 8 images in three copies, each a grade darker.
PIXELS = """SELECT vec_id AS image_id, CAST(8 AS INT) AS height, CAST(8 AS INT) AS width, CAST(3 AS INT) AS channels,
concat(transform(embedding, x -> CAST(round((CAST(x AS DOUBLE) + 1) * 127) AS FLOAT)), transform(embedding, x -> CAST(round((CAST(x AS DOUBLE) + 1) * 120) AS FLOAT)), transform(embedding, x -> CAST(round((CAST(x AS DOUBLE) + 1) * 100) AS FLOAT))) AS pixels FROM {embeddings}"""
PIXELS_ORACLE = """SELECT vec_id AS image_id, CAST(8 AS INT) AS height, CAST(8 AS INT) AS width, CAST(3 AS INT) AS channels,
list_concat(list_concat(list_transform(embedding, lambda x: CAST(round((CAST(x AS DOUBLE) + 1) * 127) AS FLOAT)), list_transform(embedding, lambda x: CAST(round((CAST(x AS DOUBLE) + 1) * 120) AS FLOAT))), list_transform(embedding, lambda x: CAST(round((CAST(x AS DOUBLE) + 1) * 100) AS FLOAT))) AS pixels FROM {embeddings}"""

#: The same images at three times the size, by repeating pixels.
LARGE = """SELECT vec_id AS image_id, CAST(24 AS INT) AS height, CAST(24 AS INT) AS width, CAST(3 AS INT) AS channels, transform(sequence(0, 1727),
i -> CAST(round((CAST(embedding[CAST(floor(i % 576 / 72) * 8 + floor(i % 24 / 3) AS INT)] AS DOUBLE) + 1) * CASE WHEN i < 576 THEN 127 WHEN i < 1152 THEN 120 ELSE 100 END) AS FLOAT)) AS pixels FROM {embeddings}"""

#: Two layers of 64 values: 1 x 8 x 8 and 4 x 4 x 4.
FEATURES = """SELECT vec_id AS image_id, 'layer2' AS layer, CAST(1 AS INT) AS c, CAST(8 AS INT) AS h, CAST(8 AS INT) AS w, embedding AS values FROM {embeddings}
UNION ALL SELECT vec_id, 'layer3', CAST(4 AS INT), CAST(4 AS INT), CAST(4 AS INT), embedding FROM {embeddings}"""

GATE = """SELECT 'u' || CAST(event_id AS STRING) || CASE event_id % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' WHEN 3 THEN '' WHEN 4 THEN '.Tiff' ELSE '.bmp' END AS filename,
CASE WHEN event_id % 53 = 0 THEN 0 WHEN event_id % 59 = 0 THEN 30000000 ELSE event_id % 1000 + 1 END AS length, CASE WHEN event_id % 61 = 0 THEN NULL ELSE value END AS score FROM {events}"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over the tables of a folder."""
    names = [n for n in ("events", "lineitem", "documents", "labels", "embeddings") if "{" + n + "}" in sql]
    return spark.sql(sql.replace("JSON_K", "get_json_object(props, '$.k')"), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def oracle(sql: str) -> str:
    """The view as a DuckDB subquery."""
    sql = sql.replace("JSON_K", "json_extract_string(props, '$.k')")
    for n in ("events", "lineitem", "documents", "labels", "embeddings"):
        sql = sql.replace("{" + n + "}", n)
    return f"({sql})"
