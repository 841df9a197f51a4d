"""Registered queries: densities, shares, thresholds, posteriors, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharewise.operators import calibration as cal
from sharewise.operators import density as dn
from sharewise.operators import drift
from sharewise.plans import materialize, store
from sharewise.suite.common import (
    CELLS_SQL, DENSITY_SQL, HIST_ONLY_SQL, HIST_SQL, R, ROW_KEY, ROW_KEY_SQL, SCORED_SQL, SHARE_SQL, STATE_SQL,
    bisect_sql, query, r6, scored, test_rows, train_rows,
)


def fitted_pair(spark, sf_dir):
    return materialize(dn.class_pair(dn.density_sliding(train_rows(spark, sf_dir))))


def fitted_hist(spark, sf_dir):
    return materialize(dn.class_pair(dn.density_hist(train_rows(spark, sf_dir))))


def test_share(spark, sf_dir, pair):
    return materialize(cal.prevalence_ml(cal.likelihood_cells(test_rows(spark, sf_dir), pair)))


@query("density_sliding", f"WITH {DENSITY_SQL} SELECT cls, bin, round(density, 9) + 0.0 AS density FROM dens")
def density_sliding(spark, sf_dir):
    d = dn.density_sliding(train_rows(spark, sf_dir))
    return d.select("cls", "bin", F.round("density", 9).alias("density"))


@query("density_hist", f"WITH {HIST_SQL} SELECT cls, bin, {R('density')} AS density FROM hist")
def density_hist(spark, sf_dir):
    return r6(dn.density_hist(train_rows(spark, sf_dir)))


def with_missing(rows):
    """Scores nulled where the part key ends in 3: those rows take no part."""
    return rows.withColumn("p", F.when(F.col("l_partkey") % 10 != 3, F.col("p")))


_THERE = "AND l_partkey % 10 <> 3"


@query(
    "density_hist_with_missing",
    f"WITH {HIST_SQL} SELECT cls, bin, {R('density')} AS density FROM hist".replace("split = 'train'", f"split = 'train' {_THERE}"),
)
def density_hist_with_missing(spark, sf_dir):
    return r6(dn.density_hist(with_missing(train_rows(spark, sf_dir))))


@query(
    "prevalence_with_missing",
    f"WITH RECURSIVE {SHARE_SQL} SELECT {R('pi')} AS pi, (SELECT CAST(sum(c) AS BIGINT) FROM cells) AS n FROM share".replace(
        "split = 'test'", f"split = 'test' {_THERE}"
    ),
)
def prevalence_with_missing(spark, sf_dir):
    pair = fitted_pair(spark, sf_dir)
    return r6(cal.prevalence_ml(cal.likelihood_cells(with_missing(test_rows(spark, sf_dir)), pair)))


_NEAREST = """firsts AS (SELECT y AS cls, p AS s, sum(count(*)) OVER (PARTITION BY y ORDER BY p) - count(*) AS i
           FROM scored WHERE split = 'train' GROUP BY y, p)"""


@query(
    "nearest_rank_lookup",
    f"""WITH {SCORED_SQL}, {_NEAREST},
targets AS (SELECT DISTINCT y AS cls, p + CAST(0.1 AS DOUBLE) AS t FROM scored WHERE split = 'test'),
gaps AS (SELECT cls, t, i, row_number() OVER (PARTITION BY cls, t ORDER BY (t - s) * (t - s), i) AS r
         FROM targets JOIN firsts USING (cls))
SELECT cls, {R('t')} AS t, CAST(i AS BIGINT) AS idx FROM gaps WHERE r = 1""",
)
def nearest_rank_lookup(spark, sf_dir):
    train = train_rows(spark, sf_dir).select(F.col("y").alias("cls"), F.col("p").alias("s"))
    targets = test_rows(spark, sf_dir).select(F.col("y").alias("cls"), (F.col("p") + 0.1).alias("t"))
    return r6(dn.nearest_rank(train, targets, ["cls"]))


_RADIUS_SQL = f"""{_NEAREST},
points AS (SELECT DISTINCT p AS x, 1 AS wanted FROM scored WHERE split = 'test'
           UNION ALL SELECT (g + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE), 0 FROM range(0, 1000) r(g)),
ends AS (SELECT DISTINCT x, x + d AS t FROM points, (VALUES (CAST(0.1 AS DOUBLE)), (CAST(-0.1 AS DOUBLE))) v(d)),
gaps AS (SELECT cls, x, t, i, row_number() OVER (PARTITION BY cls, x, t ORDER BY (t - s) * (t - s), i) AS r
         FROM ends, firsts),
f AS (SELECT cls, x, (max(i) - min(i)) / (least(x + CAST(0.1 AS DOUBLE), 1) - greatest(x - CAST(0.1 AS DOUBLE), 0)) AS f
      FROM gaps WHERE r = 1 GROUP BY cls, x),
area AS (SELECT cls, sum(f.f) / 1000 AS area FROM f JOIN points USING (x) WHERE wanted = 0 GROUP BY cls)"""


@query(
    "density_radius",
    f"""WITH {SCORED_SQL}, {_RADIUS_SQL}
SELECT cls, {R('x')} AS x, {R('f.f / area')} AS density
FROM f JOIN points USING (x) JOIN area USING (cls) WHERE wanted = 1""",
)
def density_radius(spark, sf_dir):
    train = train_rows(spark, sf_dir).select(F.col("y").alias("cls"), "p")
    points = test_rows(spark, sf_dir).select("p").distinct().select(
        F.col("p").alias("x"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cls")
    )
    return r6(dn.density_radius(train, points, ["cls"]))


@query(
    "density_lookup",
    f"""WITH {DENSITY_SQL}
SELECT {ROW_KEY_SQL}, round(dt, 9) AS dt, round(df, 9) AS df
FROM scored JOIN pair ON bin = CAST(floor(p * 999) AS INTEGER) WHERE split = 'test'""",
)
def density_lookup(spark, sf_dir):
    rows = dn.density_lookup(test_rows(spark, sf_dir), fitted_pair(spark, sf_dir), dn.sliding_bin("p"))
    return rows.select(*ROW_KEY, F.round("dt", 9).alias("dt"), F.round("df", 9).alias("df"))


@query(
    "prevalence_ml",
    f"WITH RECURSIVE {SHARE_SQL} SELECT {R('pi')} AS pi, (SELECT CAST(sum(c) AS BIGINT) FROM cells) AS n FROM share",
)
def prevalence_ml(spark, sf_dir):
    pair = fitted_pair(spark, sf_dir)
    return r6(cal.prevalence_ml(cal.likelihood_cells(test_rows(spark, sf_dir), pair)))


_PROFILE = f"""{DENSITY_SQL}, {CELLS_SQL},
profile AS (SELECT g / CAST(1000 AS DOUBLE) AS pi,
                   sum(CASE WHEN dt * g / 1000 + df * (1000 - g) / 1000 > 0
                            THEN c * ln(dt * (g / CAST(1000 AS DOUBLE)) + df * (1 - g / CAST(1000 AS DOUBLE)))
                            ELSE CAST('-inf' AS DOUBLE) END) AS loglik
            FROM cells, range(0, 1001) r(g) GROUP BY g)"""


@query("loglik_profile", f"WITH {_PROFILE} SELECT {R('pi')} AS pi, round(loglik, 3) AS loglik FROM profile")
def loglik_profile(spark, sf_dir):
    pair = fitted_pair(spark, sf_dir)
    out = cal.loglik_profile(cal.likelihood_cells(test_rows(spark, sf_dir), pair))
    return out.select(F.round("pi", 6).alias("pi"), F.round("loglik", 3).alias("loglik"))


@query(
    "prevalence_grid",
    f"WITH {_PROFILE} SELECT {R('pi')} AS pi, round(loglik, 3) AS loglik FROM profile ORDER BY profile.loglik DESC, profile.pi LIMIT 1",
)
def prevalence_grid(spark, sf_dir):
    pair = fitted_pair(spark, sf_dir)
    out = cal.prevalence_grid(cal.likelihood_cells(test_rows(spark, sf_dir), pair))
    return out.select(F.round("pi", 6).alias("pi"), F.round("loglik", 3).alias("loglik"))


@query(
    "prevalence_by_batch",
    f"""WITH RECURSIVE {DENSITY_SQL},
cells AS (SELECT l_linestatus, c, dt, df FROM
  (SELECT l_linestatus, CAST(floor(p * 999) AS INTEGER) AS bin, count(*) AS c FROM scored WHERE split = 'test' GROUP BY 1, 2) b JOIN pair USING (bin)),
bis(s, k, lo) AS (
  SELECT l_linestatus, 0, CAST(0 AS DOUBLE) FROM cells GROUP BY 1
  UNION ALL
  SELECT s, k + 1, lo + CASE WHEN (SELECT sum(c * (dt - df) / (dt * (lo + pow(2, -(k + 1))) + df * (1 - (lo + pow(2, -(k + 1))))))
                                   FROM cells WHERE l_linestatus = s) > 0 THEN pow(2, -(k + 1)) ELSE 0 END
  FROM bis WHERE k < 40)
SELECT s AS l_linestatus, {R('max(lo)')} AS pi, (SELECT CAST(sum(c) AS BIGINT) FROM cells WHERE l_linestatus = s) AS n
FROM bis GROUP BY s""",
)
def prevalence_by_batch(spark, sf_dir):
    pair = fitted_pair(spark, sf_dir)
    keys = ["l_linestatus"]
    return r6(cal.prevalence_ml(cal.likelihood_cells(test_rows(spark, sf_dir), pair, keys), keys))


@query(
    "prevalence_points",
    f"""WITH RECURSIVE {DENSITY_SQL},
cells AS (SELECT p, count(*) AS c, any_value(dt) AS dt, any_value(df) AS df
          FROM scored JOIN pair ON bin = CAST(floor(p * 999) AS INTEGER) WHERE split = 'test' GROUP BY p),
{bisect_sql()}
SELECT {R('pi')} AS pi, (SELECT CAST(sum(c) AS BIGINT) FROM cells) AS n FROM share""",
)
def prevalence_points(spark, sf_dir):
    points = test_rows(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    dense = dn.density_lookup(points, fitted_pair(spark, sf_dir), dn.sliding_bin("p"))
    return r6(cal.prevalence_points(store(dense.select("c", "dt", "df"), "points")))


@query(
    "prevalence_radius",
    f"""WITH RECURSIVE {SCORED_SQL}, {_RADIUS_SQL},
tested AS (SELECT p AS x, count(*) AS c FROM scored WHERE split = 'test' GROUP BY 1),
cells AS (SELECT x, c, max(CASE WHEN cls = 1 THEN f.f / area END) AS dt, max(CASE WHEN cls = 0 THEN f.f / area END) AS df
          FROM f JOIN tested USING (x) JOIN area USING (cls) GROUP BY 1, 2),
{bisect_sql()}
SELECT {R('pi')} AS pi, (SELECT CAST(sum(c) AS BIGINT) FROM cells) AS n FROM share""",
)
def prevalence_radius(spark, sf_dir):
    """The share by nearest-rank densities, which have no cells."""
    at = dn.radius_pair(train_rows(spark, sf_dir), test_rows(spark, sf_dir))
    return r6(cal.prevalence_points(at))


@query("calibrated_threshold", f"WITH RECURSIVE {STATE_SQL} SELECT {R('threshold')} AS threshold FROM state")
def calibrated_threshold(spark, sf_dir):
    pair = fitted_pair(spark, sf_dir)
    return r6(cal.calibrated_threshold(test_rows(spark, sf_dir), test_share(spark, sf_dir, pair)))


@query(
    "predict_calibrated",
    f"WITH RECURSIVE {STATE_SQL} SELECT {ROW_KEY_SQL}, p >= threshold AS cal_label FROM scored, state WHERE split = 'test'",
)
def predict_calibrated(spark, sf_dir):
    rows = test_rows(spark, sf_dir)
    state = cal.calibrate(rows, fitted_pair(spark, sf_dir))
    return cal.predict_calibrated(rows, state).select(*ROW_KEY, "cal_label")


@query("predict_raw", f"WITH {SCORED_SQL} SELECT {ROW_KEY_SQL}, p > 0.5 AS raw_label FROM scored")
def predict_raw(spark, sf_dir):
    return cal.predict_raw(scored(spark, sf_dir)).select(*ROW_KEY, "raw_label")


_POST = "pi * dt / (pi * dt + (1 - pi) * df)"


@query(
    "posterior_calibrated",
    f"""WITH RECURSIVE {SHARE_SQL} SELECT {ROW_KEY_SQL}, {R(_POST)} AS cal_proba
FROM scored JOIN pair ON bin = CAST(floor(p * 999) AS INTEGER), share WHERE split = 'test'""",
)
def posterior_calibrated(spark, sf_dir):
    pair = fitted_pair(spark, sf_dir)
    rows = cal.posterior_calibrated(test_rows(spark, sf_dir), pair, test_share(spark, sf_dir, pair))
    return r6(rows.select(*ROW_KEY, "cal_proba"))


@query(
    "calibrate_scores",
    f"""WITH RECURSIVE {DENSITY_SQL},
cells AS (SELECT c, dt, df FROM
  (SELECT CAST(floor(p * 999) AS INTEGER) AS bin, count(*) AS c FROM scored GROUP BY 1) b JOIN pair USING (bin)),
{bisect_sql()}
SELECT {ROW_KEY_SQL}, {R(_POST)} AS cal_proba FROM scored JOIN pair ON bin = CAST(floor(p * 999) AS INTEGER), share""",
)
def calibrate_scores(spark, sf_dir):
    bare = scored(spark, sf_dir).select(*ROW_KEY, "p")
    return r6(cal.calibrate_scores(bare, fitted_pair(spark, sf_dir)).select(*ROW_KEY, "cal_proba"))


@query("proba_raw", f"WITH {SCORED_SQL} SELECT {ROW_KEY_SQL}, {R('1 - p')} AS p0, {R('p')} AS p1 FROM scored")
def proba_raw(spark, sf_dir):
    rows = cal.proba_raw(scored(spark, sf_dir))
    return r6(rows.select(*ROW_KEY, F.col("proba")[0].alias("p0"), F.col("proba")[1].alias("p1")))


_MIX = f"""{SHARE_SQL},
{HIST_ONLY_SQL},
observed AS (SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(c, 0) AS c, CAST(sum(coalesce(c, 0)) OVER () AS DOUBLE) AS m
             FROM range(0, 3) r(bin) LEFT JOIN
               (SELECT least(CAST(floor(p * 3) AS INTEGER), 2) AS bin, count(*) AS c FROM scored WHERE split = 'test' GROUP BY 1) o USING (bin)),
mix AS (SELECT bin, m, c / m AS h1,
               pi * (SELECT density FROM hist h WHERE h.cls = 1 AND h.bin = observed.bin)
               + (1 - pi) * (SELECT density FROM hist h WHERE h.cls = 0 AND h.bin = observed.bin) AS h0
        FROM observed, share),
eps AS (SELECT least(min(h0) FILTER (h0 > 0), min(h1) FILTER (h1 > 0)) / 1000 AS e FROM mix)"""
_KS = "(SELECT max(abs(a - b)) FROM (SELECT sum(h0) OVER (ORDER BY bin) AS a, sum(h1) OVER (ORDER BY bin) AS b FROM mix))"
_KL1 = "(SELECT sum(h1 * ln((h1 + e) / (h0 + e))) FROM mix, eps)"
_KL0 = "(SELECT sum(h0 * ln((h0 + e) / (h1 + e))) FROM mix, eps)"
_CHI = "(SELECT sum(pow((h1 - h0) * m, 2) / (h0 * m + 0.0001)) FROM mix)"
# P(3/2, h) = erf(sqrt h) - 2 sqrt(h / pi) e^-h, by the same series as any incomplete gamma function.
_SIG = f"""(SELECT CASE WHEN h > 700 THEN 1.0 ELSE least(1.0, exp(1.5 * ln(h) - h - lgamma(2.5)) *
  (1 + (SELECT sum(exp(k * ln(h) + lgamma(2.5) - lgamma(2.5 + k))) FROM range(1, 3001) r(k)))) END
  FROM (SELECT {_CHI} / 2 AS h))"""


def _mix(spark, sf_dir):
    share = test_share(spark, sf_dir, fitted_pair(spark, sf_dir))
    return materialize(drift.mixture_histogram(test_rows(spark, sf_dir), fitted_hist(spark, sf_dir), share))


@query("mixture_histogram", f"WITH RECURSIVE {_MIX} SELECT bin, {R('h0')} AS h0, {R('h1')} AS h1, CAST(m AS BIGINT) AS m FROM mix")
def mixture_histogram(spark, sf_dir):
    return r6(_mix(spark, sf_dir))


@query("ks_statistic", f"WITH RECURSIVE {_MIX} SELECT {R(_KS)} AS ks")
def ks_statistic(spark, sf_dir):
    return r6(drift.ks_statistic(_mix(spark, sf_dir)))


@query(
    "kl_divergence",
    f"""WITH RECURSIVE {_MIX} SELECT {R(_KL1)} AS dkl_observed_expected, {R(_KL0)} AS dkl_expected_observed,
{R(f'({_KL1} + {_KL0}) / 2')} AS dkl""",
)
def kl_divergence(spark, sf_dir):
    return r6(drift.kl_divergence(_mix(spark, sf_dir)))


@query("chi2_fit", f"WITH RECURSIVE {_MIX} SELECT {R(_CHI)} AS chi2, {R(_SIG)} AS chi2_sig")
def chi2_fit(spark, sf_dir):
    return r6(drift.chi2_fit(_mix(spark, sf_dir)))


@query(
    "compare_distributions",
    f"WITH RECURSIVE {_MIX} SELECT {R(_KS)} AS ks, {R(f'({_KL1} + {_KL0}) / 2')} AS dkl, {R(_CHI)} AS chi2, {R(_SIG)} AS chi2_sig",
)
def compare_distributions(spark, sf_dir):
    return r6(drift.compare_distributions(_mix(spark, sf_dir)))
