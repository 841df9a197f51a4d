"""The paths that only large or skewed data take give the same rows as the short ones."""

import re
from functools import partial

import pytest
from pyspark.sql import functions as F

from sharewise.operators import calibration as cal
from sharewise.operators import metrics as mt
from sharewise.operators import sampling as sp
from sharewise.plans import dense_index, lookup, materialize, running_before, state
from sharewise.suite import QUERIES


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_broadcast(spark, how):
    # One key holds a third of all rows.
    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("k"))
    table = spark.range(600).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    plain = lookup(rows, table, ["k"], how, bound=600)
    salted = lookup(rows, table, ["k"], how, broadcast_rows=10)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert pairs(plain, "id", "k", "v") == pairs(salted, "id", "k", "v")


def test_running_totals_over_many_pieces(spark, settings):
    with settings(spark__sql__adaptive__coalescePartitions__enabled="false"):
        df = spark.range(1000).select(
            F.when(F.col("id") < 700, "hot").otherwise("cold").alias("g"), F.col("id"), (F.col("id") % 5).alias("m")
        )
        got = running_before(df, ["g"], ["id"], {"before": "m", "place": 1})
        want, place = {}, {}
        for i in range(1000):
            g = "hot" if i < 700 else "cold"
            want[i], place[i] = sum(j % 5 for j in range(700 if g == "cold" else 0, i)), i - (700 if g == "cold" else 0)
        rows = got.collect()
        assert {r["id"]: r["before"] for r in rows} == want and {r["id"]: r["place"] for r in rows} == place
        words = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("w"))
        numbered = {r["w"]: r["idx"] for r in dense_index(words, ["w"]).collect()}
        assert numbered == {w: i for i, w in enumerate(sorted(numbered))}


def test_metrics_over_many_pieces(spark, settings):
    df = spark.range(4000).select(
        (F.col("id") % 2).alias("m"),
        (F.hash("id") % 3 == 0).cast("int").alias("y"),
        # A third of the scores is one value, another third lies within 1e-9 of it.
        F.when(F.col("id") % 3 == 0, 0.25)
        .when(F.col("id") % 3 == 1, 0.25 + F.col("id") * 1e-13)
        .otherwise(F.col("id") / 4001.0)
        .alias("p"),
    )
    df = materialize(df)
    one = mt.auroc(df, ["m"]).orderBy("m").collect()
    curve = pairs(mt.roc_curve(df, ["m"]), "m", "threshold", "fpr", "tpr")
    shares = spark.createDataFrame([(0.62, 4000)], "pi DOUBLE, n BIGINT")
    cut = cal.calibrated_threshold(df, shares).head()[0]
    with settings(spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert mt.auroc(df, ["m"]).orderBy("m").collect() == one
        assert pairs(mt.roc_curve(df, ["m"]), "m", "threshold", "fpr", "tpr") == curve
        assert cal.calibrated_threshold(df, shares).head()[0] == cut
    ordered = sorted(r["p"] for r in df.select("p").collect())
    assert cut == ordered[int((1 - 0.62) * 4000)]


def _brute_auroc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auroc_against_all_pairs(spark):
    df = spark.range(200).select((F.hash("id") % 2 == 0).cast("int").alias("y"), ((F.col("id") * 7) % 23 / 23.0).alias("p"))
    rows = [(r["y"], r["p"]) for r in df.collect()]
    assert mt.auroc(df).head()[0] == pytest.approx(_brute_auroc(rows))


PLANS = [
    "clean_documents", "strat_split", "term_counts", "fit_idf", "tfidf", "mean_embedding", "score_linear",
    "density_sliding", "density_radius", "prevalence_ml", "posterior_calibrated", "four_variant_report",
    "auroc", "overlap_weights", "weighted_vote", "threshold_sweep", "rho_ovo",
]


@pytest.mark.parametrize("name", PLANS)
def test_plans_stay_on_the_jvm_without_cross_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "PythonUDF", "EvalPython"):
        assert word not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["auroc"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in plan
    plan = QUERIES["contains_string"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,que)" in plan and "n_chars" not in plan


@pytest.mark.parametrize("n", [1, 499, 500, 999])
def test_cut_among_keys_of_one_hash(spark, monkeypatch, n):
    # Every hash has the same upper bits, and 250 keys each share a whole one.
    monkeypatch.setattr(sp, "hash32", lambda seed, *key: F.pmod(F.col("id"), F.lit(4)).cast("long"))
    rows = spark.range(1000).withColumn("g", F.when(F.col("id") % 2 == 0, "a"))
    want = sorted(range(1000), key=lambda i: (i % 4, i))[:n]
    assert sorted(r["id"] for r in sp.sample_n(rows, ["id"], n).collect()) == sorted(want)
    half = n // 2
    got = {(r["g"], r["id"]) for r in sp.sample_n(rows, ["id"], half, strata=["g"]).collect()}
    kept = [sorted((i for i in range(1000) if i % 2 == odd), key=lambda i: (i % 4, i))[:half] for odd in (0, 1)]
    assert got == {("a", i) for i in kept[0]} | {(None, i) for i in kept[1]}


def test_cut_in_a_crowded_cell_ranks_no_rows(spark, monkeypatch):
    # A million rows share the upper 16 bits of the hash.
    monkeypatch.setattr(sp, "hash32", lambda seed, *key: F.pmod(F.col("id") * 40503, F.lit(65536)).cast("long"))
    rows, plans, real = spark.range(1_000_000), [], sp.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(sp, "materialize", seen)
    cut = sp.cutoffs(rows, ["id"], lambda n: F.lit(123_456)).head()
    placed = rows.select(F.pmod(F.col("id") * 40503, F.lit(65536)).alias("h"), "id")
    below = placed.where((F.col("h") < cut["cut_h"]) | ((F.col("h") == cut["cut_h"]) & (F.col("id") <= cut["cut_k"]["id"])))
    assert below.count() == 123_456
    # Windows see counts, at most 2^16 of a stratum, or the keys of one hash; no row is ranked.
    assert len(plans) == 3 and all("row_number" not in p and "Window [sum(_c" in p for p in plans)
    assert re.search(r"windowspecdefinition\([^)]*_h#\d+L, _k#", plans[2])


def test_repeated_keys_stand_or_fall_together(spark):
    rows = spark.createDataFrame([(i % 5,) for i in range(20)], "id BIGINT")
    kept = [r["id"] for r in sp.sample_n(rows, ["id"], 6).collect()]
    assert len(kept) == 8 and all(kept.count(i) == 4 for i in kept)


def test_shares_of_many_keys_by_points(spark, monkeypatch):
    # Two rows a key, c times (0.9, 0.1) and 10 - c times (0.1, 0.9): the share has a closed form.
    keys, up = 100_000, F.col("k") % 11
    both = F.array(
        F.struct(up.alias("c"), F.lit(0.9).alias("dt"), F.lit(0.1).alias("df")),
        F.struct((F.lit(10) - up).alias("c"), F.lit(0.1).alias("dt"), F.lit(0.9).alias("df")),
    )
    points = materialize(spark.range(keys).select(F.col("id").alias("k")).select("k", F.inline(both)))
    plain, most = type(points).collect, []

    def counted(df):
        rows = plain(df)
        most.append(len(rows))
        return rows

    monkeypatch.setattr(type(points), "collect", counted)
    got = cal.prevalence_points(points, ["k"])
    assert max(most) <= 1
    want = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (up / 10.0 - 0.1) / 0.8))
    row = got.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("k").alias("keys"), F.max(F.abs(F.col("pi") - want)).alias("miss"), F.min("n").alias("n")
    ).head()
    assert (row["rows"], row["keys"], row["n"]) == (keys, keys, 10) and row["miss"] < 1e-9


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_shares_by_points_of_null_keys_and_no_rows(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(cal, "lookup", partial(lookup, broadcast_rows=broadcast_rows))
    rows = [(None, 7, 0.9, 0.1), (None, 3, 0.1, 0.9), ("a", 4, 0.9, 0.1), ("a", 6, 0.1, 0.9)]
    points = spark.createDataFrame(rows, "k STRING, c BIGINT, dt DOUBLE, df DOUBLE")
    got = {r["k"]: (round(r["pi"], 9), r["n"]) for r in cal.prevalence_points(points, ["k"]).collect()}
    assert got == {None: (0.75, 10), "a": (0.375, 10)}
    none = points.where("c < 0")
    assert cal.prevalence_points(none, ["k"]).count() == 0
    assert [tuple(r) for r in cal.prevalence_points(none.drop("k")).collect()] == [(0.0, None)]


def test_only_heavy_keys_are_repeated(spark, monkeypatch):
    # Zipf-like: key 0 holds a third of the rows, key 1 a ninth; the rest are all different.
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 9 == 1, 1).when(F.col("id") % 500 == 2, None).otherwise(F.col("id")).alias("k")
    )
    table = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    copies, real = [], state._salted

    def seen(rows, table, on):
        out = real(rows, table, on)
        copies.append((out[0].groupBy("k").agg(F.countDistinct("_salt")).where("k < 2").collect(), out[1].count()))
        return out

    monkeypatch.setattr(state, "_salted", seen)
    for how in ("inner", "left"):
        salted = lookup(rows, table, ["k"], how, broadcast_rows=10)
        assert pairs(salted.fillna(-1), "id", "k", "v") == pairs(lookup(rows, table, ["k"], how, bound=6000).fillna(-1), "id", "k", "v")
    for heavy, size in copies:
        assert 6000 < size < 12000 and size <= 6000 + 4 * 8 + 32
        # A third of the rows goes to a third of four times the partitions.
        assert sorted(tuple(r) for r in heavy) == [(0, 11), (1, 4)]
