"""Numbers worked out independently of this package, for a fixture with a known shift."""

import pytest
from pyspark.sql import functions as F

from sharewise.operators import calibration as cal
from sharewise.operators import density as dn
from sharewise.operators import metrics as mt
from sharewise.plans import materialize


@pytest.fixture(scope="module")
def golden(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    p = F.lit(0.0005) + F.lit(0.6) * F.col("l_quantity") / 50 + F.lit(0.5) * F.col("l_discount") + F.lit(0.3) * y
    rows = line.where("l_orderkey % 2 = 0 OR l_returnflag <> 'R' OR l_linenumber % 3 = 0").select(
        y.alias("y"), p.alias("p"), F.when(F.col("l_orderkey") % 2 == 0, "train").otherwise("test").alias("split")
    )
    rows = materialize(rows)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@pytest.fixture(scope="module")
def pair(golden):
    return materialize(dn.class_pair(dn.density_sliding(golden[0])))


def test_sizes(golden):
    train, test = golden
    assert train.groupBy().agg(F.sum("y"), F.sum(1 - F.col("y"))).head()[:] == (972, 1989)
    assert test.groupBy().agg(F.sum("y"), F.sum(1 - F.col("y"))).head()[:] == (281, 2043)


def test_share_threshold_posterior(golden, pair):
    _, test = golden
    cells = cal.likelihood_cells(test, pair)
    assert cal.prevalence_grid(cells).head()["pi"] == pytest.approx(0.111)
    shares = materialize(cal.prevalence_ml(cells))
    pi = shares.head()["pi"]
    assert pi == pytest.approx(0.110840, abs=1e-6)
    assert cal.calibrated_threshold(test, shares).head()["threshold"] == pytest.approx(0.6035)
    post = cal.posterior_calibrated(test, pair, shares).agg(F.sum("cal_proba"), F.avg("cal_proba")).head()
    assert post[0] == pytest.approx(257.592, abs=1e-3)
    # At an inner optimum the posteriors add up to the share.
    assert post[1] == pytest.approx(pi, abs=1e-6)


def test_share_from_points_agrees(golden, pair):
    _, test = golden
    points = dn.density_lookup(test.groupBy("p").agg(F.count(F.lit(1)).alias("c")), pair, dn.sliding_bin("p"))
    assert cal.prevalence_points(materialize(points.select("c", "dt", "df"))).head()["pi"] == pytest.approx(0.110840, abs=1e-6)


def test_metrics(golden):
    _, test = golden
    row = mt.metric_bundle(test).head()
    assert row["tp"] == 281
    for name, want in {
        "auroc": 0.879134, "spcc": 0.499963, "acc": 0.777969, "ba": 0.752480, "mcc": 0.368718, "bias": 0.243925
    }.items():
        assert row[name] == pytest.approx(want, abs=1e-6), name
    assert mt.count_bias(test).head()["bias"] == pytest.approx(0.243925, abs=1e-6)


def test_invariants(golden, pair):
    train, test = golden
    for density in (dn.density_sliding(train), dn.density_hist(train)):
        for total in density.groupBy("cls").agg(F.sum("density").alias("t")).collect():
            assert total["t"] == pytest.approx(1.0)
    hard = test.withColumn("label", (F.col("p") >= 0.5).cast("double"))
    row = mt.metric_bundle(hard, pred="label").head()
    assert row["auroc"] == pytest.approx(row["ba"])
    assert row["spcc"] == pytest.approx(hard.select(F.corr("y", "label")).head()[0])
