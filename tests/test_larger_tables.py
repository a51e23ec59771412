"""What only shows on more rows than the test tables have."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_oracles import rows

from oodspark import sources
from oodspark.functions import kernels
from oodspark.operators import images, patches
from oodspark.plans import registry


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """embeddings with more than 4,000 rows of a label and some of the next, which is out-of-distribution."""
    folder, rng = tmp_path_factory.mktemp("many"), np.random.default_rng(7)
    n = 5200
    vectors = rng.normal(size=(n, 64)).astype(np.float32) / 8
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(vectors), pa.list_(pa.float32())), "label": np.where(np.arange(n) % 13 < 11, 6, 7).astype(np.int32)}), folder / "embeddings.parquet")
    return str(folder)


def same(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert rows(registry.QUERIES[name](spark, folder).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())

def test_images_keep_apart(spark, many):
    """An image's id is its own, and what it was while 1,000 ids were enough."""
    from oodspark.plans import queries

    got = queries.patch_view(spark, many).selectExpr("image_id", "vec_id", "label", "patch_row", "patch_col", "CASE WHEN label = 1 THEN 7 ELSE 6 END AS of").toPandas()
    assert not got.duplicated(["image_id", "patch_row", "patch_col"]).any()
    assert (got.groupby("image_id")["label"].nunique() == 1).all()
    got = got.sort_values(["of", "vec_id"])
    nth = got.groupby("of").cumcount() // 4
    assert (got["image_id"] == got["of"] * 1000 + nth)[nth < 1000].all()


@pytest.mark.parametrize("name", ["patch_maps"])
def test_as_its_sql(spark, many, name):
    same(spark, many, name)


@pytest.mark.parametrize("name", ["evaluate_end_to_end", "evaluate_reconstruction"])
def test_evaluated(spark, many, name):
    same(spark, many, name)


def test_pairs(spark):
    """All pairs, from a bank that is sent and from one that isn't; equal vectors are 0 apart, and no join makes the pairs of a small bank."""
    rng = np.random.default_rng(4)
    bank, asked = rng.normal(size=(700, 5)), rng.normal(size=(40, 5))
    asked[:3], asked[3] = bank[:3], bank[4] + 1e-9
    frame = lambda name, v: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"{name} long, embedding array<double>")
    want = np.linalg.norm(asked[:, None] - bank[None], axis=2)
    sent = patches.knn_pairwise(frame("vec_id", asked), frame("bank_id", bank))
    for df in (sent, patches.knn_pairwise(frame("vec_id", asked), frame("bank_id", bank), broadcast_bytes=0)):
        got = df.toPandas()
        assert list(got.columns) == ["vec_id", "bank_id", "distance"] and len(got) == want.size
        assert np.allclose(got["distance"], want[got["vec_id"], got["bank_id"]], rtol=1e-9, atol=0)
    assert "Join" not in sent._jdf.queryExecution().executedPlan().toString()


def test_distances_in_slices():
    """What is held beside points and bank doesn't grow with the number of points."""
    rng = np.random.default_rng(5)
    points, bank = rng.normal(size=(6000, 4)), rng.normal(size=(5000, 4))
    tracemalloc.start()
    got = kernels.smallest_distances(points, bank, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64e6
    assert np.allclose(got[::500], np.sort(np.linalg.norm(points[::500, None] - bank[None], axis=2), axis=1)[:, :3])


def test_corrupted_in_slices(spark):
    """Whatever the batch, a few images are held at a time; each is what the kernel makes of it."""

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = images.corrupted(Rows(), ["border_crop"])
    rng = np.random.default_rng(6)
    pixels = rng.integers(0, 256, (1000, 3 * 6 * 6)).astype(np.float32)
    ids = np.arange(1000) + (1 << 33)
    batch = pa.RecordBatch.from_pydict({"image_id": ids, "height": [6] * 1000, "width": [6] * 1000, "channels": [3] * 1000, "pixels": pa.array(list(pixels), pa.list_(pa.float32())), "kind": ["border_crop"] * 1000})
    out = list(run(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= images.TOGETHER
    got = pa.Table.from_batches(out)
    assert got["image_id"].to_pylist() == list(ids)
    for i in (0, 63, 64, 999):
        want = kernels.corrupted(pixels[i].reshape(3, 6, 6).transpose(1, 2, 0).astype(np.uint8), "border_crop", [42, int(ids[i]), int(ids[i]) >> 32, 2])
        assert got["pixels"][i].as_py() == list(want.transpose(2, 0, 1).ravel())


def test_many_files(spark, tmp_path):
    """Files are written with a line feed, nothing beside them, and few tasks list their folders, however many there are."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    names = [f"n{i}" for i in range(100)] + ["a/b%", 'c"d']
    sources.write_files(spark.createDataFrame([(n, n.encode()) for n in names], "name string, data binary"), f"file://{tmp_path}/files")
    assert [p.read_text() for p in sorted((tmp_path / "files").glob("*/*")) if p.name.startswith("part-")] == [n + "\n" for n in sorted(names, key=lambda n: {"a/b%": "a%2Fb%25", 'c"d': "c%22d"}.get(n, n))]
    assert len(list((tmp_path / "files").rglob("*"))) == 2 * len(names)
    with pytest.raises(sources.SourceError):
        sources.write_files(spark.createDataFrame([("x", b"")], "name string, data binary"), f"file://{tmp_path}/files")
    with sources.listed(spark):
        assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
    assert sources.read_images(spark, f"{tmp_path}/files").count() == len(names)
