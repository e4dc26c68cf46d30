"""All quantiles of a class summary in one search, whatever the number of variables and class levels."""

import random

import numpy as np
import pytest

from rowmill.operators import agg

STATS = ("n", "median", "p5", "p90")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2]), rng.choice([None, *map(float, range(9))]), rng.random(), None) for _ in range(500)]


SCHEMA = "g string, h int, x double, y double, z double"


def test_every_level_and_variable_equals_numpy(spark, rows):
    got = agg.proc_means(spark.createDataFrame(rows, SCHEMA), ["g", "h"], ["x", "y", "z"], STATS, nway=False).collect()
    assert len(got) == 6 + 3 + 2 + 1
    for r in got:
        part = [q for q in rows if (r._type_ & 2 == 0 or q[0] == r.g) and (r._type_ & 1 == 0 or q[1] == r.h)]
        for v, i in (("x", 2), ("y", 3), ("z", 4)):
            values = [q[i] for q in part if q[i] is not None]
            for s, p in (("median", 50), ("p5", 5), ("p90", 90)):
                want = float(np.percentile(values, p)) if values else None
                assert r[f"{v}_{s}"] == (pytest.approx(want) if values else None)


def jobs(spark, name, make):
    spark.sparkContext.setJobGroup(name, name)
    make().collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_variables_and_levels(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    one = jobs(spark, "quantiles of one", lambda: agg.proc_means(df, ["g"], ["x"], STATS))
    many = jobs(spark, "quantiles of many", lambda: agg.proc_means(df, ["g", "h"], ["x", "y", "z"], STATS, nway=False))
    assert 0 < many <= one + 2
