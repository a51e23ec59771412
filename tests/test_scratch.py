"""Intermediate tables: what deletes them, and a session setting that many threads need at once."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from oodspark import sources
from oodspark.operators import metrics


def held(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}


def test_tidy(spark):
    """All tables made in a block go with it, those of inner blocks and failed ones too, and no others."""
    scored = spark.range(100).selectExpr("CAST(id % 7 AS DOUBLE) AS score", "CAST(id % 2 AS INT) AS label")
    kept = sources.stored(scored, "kept")
    before = held(spark)
    with sources.tidy(spark):
        with pytest.raises(ZeroDivisionError), sources.tidy(spark):
            metrics.ranking_metrics(scored).collect()
            assert held(spark) > before
            raise ZeroDivisionError
        assert held(spark) == before
        row = metrics.ranking_metrics(scored).first()
        sources.released(sources.stored(scored, "released"))
    assert held(spark) == before and kept.count() == 100 and row["auroc"] is not None


def test_kept(spark):
    """A table that a block keeps lives until the scope around it ends; without one it stays."""
    before = held(spark)
    with sources.tidy(spark):
        with sources.tidy(spark) as keep:
            sources.stored(spark.range(3), "goes")
            one = keep(sources.stored(spark.range(5), "stays"))
        assert one.count() == 5 and len(held(spark) - before) == 1
    assert held(spark) == before
    with sources.tidy(spark) as keep:
        one = keep(sources.stored(spark.range(7), "stays"))
    assert one.count() == 7
    sources.released(one)
    assert held(spark) == before


def test_concurrent_writes(spark):
    """The session's setting is what it was before, whichever of several writers ends last."""
    was = spark.conf.get(sources.CLEANED)
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda n: sources.stored(spark.range(n + 1), "many"), range(8)))
    assert [t.count() for t in tables] == list(range(1, 9)) and spark.conf.get(sources.CLEANED) == was
