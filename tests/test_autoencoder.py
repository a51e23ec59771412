"""The linear autoencoder against principal components."""

import numpy as np
import pytest

from oodspark.operators import autoencoder

SCHEMA = "id long, label int, embedding array<double>"


def frame(spark, x, labels):
    return spark.createDataFrame([(i, int(y), [float(v) for v in row]) for i, (row, y) in enumerate(zip(x, labels, strict=True))], SCHEMA).repartition(5)


def test_components(spark, tmp_path):
    """Fitted on label-0 rows only, far from the origin; reconstruction errors are those of the leading components."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 12)) * 0.7 ** np.arange(12) + 100
    labels = np.arange(200) % 4 == 3
    x[labels] += rng.normal(size=(50, 12)) * 5
    model = autoencoder.fitted(frame(spark, x, labels), 3, 80)
    fit = x[~labels]
    u = np.linalg.svd(fit - fit.mean(axis=0), full_matrices=False)[2][:3].T
    assert np.allclose(model.axes @ model.axes.T, u @ u.T, atol=1e-8)
    assert np.diff(model.losses).max() < 1e-12 and len(model.losses) == 81
    far = lambda v: ((v - fit.mean(axis=0)) @ (np.eye(12) - u @ u.T)) ** 2
    assert model.losses[-1] == pytest.approx(far(fit).mean())
    got = autoencoder.scored(frame(spark, x, labels), model).orderBy("id").collect()
    assert np.allclose([r["score"] for r in got], far(x).mean(axis=1), atol=1e-8)
    assert set(got[0].asDict()) == {"id", "label", "score"}
    autoencoder.saved(model, spark, f"{tmp_path}/m", {"rank": "3"})
    again, config = autoencoder.loaded(spark, f"{tmp_path}/m")
    assert np.array_equal(again.axes, model.axes) and np.array_equal(again.mean, model.mean) and again.losses == model.losses and config == {"rank": "3"}


def test_refusals(spark):
    df = frame(spark, np.ones((3, 2)), [1, 1, 1])
    with pytest.raises(autoencoder.AutoencoderError, match="no in-distribution"):
        autoencoder.fitted(df)
    with pytest.raises(autoencoder.AutoencoderError, match="one length"):
        autoencoder.fitted(frame(spark, np.ones((2, 2)), [0, 0]).union(frame(spark, np.ones((2, 3)), [0, 0])))
    for how in ({"rank": 0}, {"turns": 0}):
        with pytest.raises(autoencoder.AutoencoderError, match="positive"):
            autoencoder.fitted(df, **how)
    same = autoencoder.fitted(frame(spark, np.ones((4, 2)), [0] * 4), 5, 2)  # no variance, and a rank above the dimensions
    assert same.losses[-1] == 0 and autoencoder.scored(df.limit(0), same).count() == 0
