"""Small inline fixtures: odd texts, odd scores, missing values."""

import math

import pytest
from pyspark.sql import functions as F

from sharewise.functions import scores as sc
from sharewise.functions import text as tx
from sharewise.operators import calibration as cal
from sharewise.operators import clean
from sharewise.operators import density as dn
from sharewise.operators import drift
from sharewise.operators import features as ft
from sharewise.operators import metrics as mt
from sharewise.operators import models as md
from sharewise.operators import multiclass as mc
from sharewise.operators import sampling as sp
from sharewise.operators import votes as vt
from sharewise.plans import materialize, shared_path
from sharewise.sources import scans, sinks


@pytest.fixture(scope="module")
def tiny_docs(spark):
    rows = [
        (1, None, "dutch", "web"),
        (2, "a  b    c", "dutch", "web"),
        (3, " ".join("w" * 3 for _ in range(9)), "english", None),
        (4, " ".join(f"wort{i}" for i in range(10)), "english", "app"),
        (5, "één café 123 x_y Straße  and  more words go in here", None, "app"),
        (6, "no break space splits these words into more than nine tokens", "dutch", None),
    ]
    return spark.createDataFrame(rows, "doc_id INT, text STRING, lang STRING, platform STRING")


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_cleaning(tiny_docs):
    filled = clean.fill_null_text(tiny_docs)
    assert filled.where("text = ' '").count() == 1
    assert ids(clean.filter_min_tokens(filled)) == [4, 5, 6]
    assert clean.collapse_double_space(filled).where("doc_id = 2").head()["text"] == "a b  c"
    cleaned = clean.clean_documents(tiny_docs)
    assert cleaned.columns == ["doc_id", "text", "lang"] and ids(cleaned) == [4, 5, 6]
    kept = clean.keep_word_tokens(tiny_docs).where("doc_id = 5").head()["text"]
    assert kept == "één café 123 x_y Straße and more words here"
    assert ids(clean.contains_string(tiny_docs, "Straße")) == [5]
    assert clean.split_words(tiny_docs).where("doc_id = 1").head()["words"] == [" "]
    flags = {r["doc_id"]: r["language"] for r in clean.language_flag(tiny_docs).collect()}
    assert flags == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 0.0}


def test_csv_round_trip(spark, tiny_docs):
    odd = tiny_docs.unionByName(
        spark.createDataFrame([(7, 'line\nbreak; "quoted", comma  ', "x;y", " ")], tiny_docs.schema)
    )
    own, other = shared_path(spark, "a"), shared_path(spark, "b")
    sinks.sink_csv(odd.where("doc_id > 3"), own, ";")
    sinks.sink_csv(odd.where("doc_id <= 3").drop("platform"), other, ";")
    back = scans.scan_csv_multi(
        spark,
        {own: "doc_id INT, text STRING, lang STRING, platform STRING", other: "doc_id INT, text STRING, lang STRING"},
    )
    assert back.columns == ["doc_id", "lang", "platform", "text"] and back.count() == 7
    assert back.where("doc_id = 7").head()["text"] == 'line\nbreak; "quoted", comma  '
    assert back.where("doc_id = 1").head()["text"] == " "
    assert back.where("doc_id = 2").head()["platform"] is None


def test_sampling_sizes_and_errors(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("label", F.when(F.col("k") < 100, 1).otherwise(0))
    again = sp.sample_n(df.repartition(7).orderBy(F.desc("k")), ["k"], 37, "s")
    first = sp.sample_n(df, ["k"], 37, "s")
    assert sorted(r[0] for r in first.select("k").collect()) == sorted(r[0] for r in again.select("k").collect())
    assert first.count() == 37
    assert sp.sample_n(df, ["k"], 0).count() == 0
    assert sp.sample_n(df, ["k"], 1000).count() == 1000
    with pytest.raises(ValueError):
        sp.sample_n(df, ["k"], 1001)
    parts = sp.head_tail_split(df, ["k"], 0.3).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"head": 300, "tail": 700}
    split = sp.strat_split(df, ["k"], "label", {0: 0.5, 1: 0.1}).groupBy("label", "part").count().collect()
    assert {(r[0], r[1]): r[2] for r in split} == {(0, "test"): 450, (0, "train"): 450, (1, "test"): 10, (1, "train"): 90}
    folds = sp.kfold_assign(df, ["k"], "label", 7).groupBy("label", "fold").count().collect()
    assert all(abs(r["count"] - (900 if r["label"] == 0 else 100) / 7) <= 1 for r in folds)
    assert [r["k"] for r in sp.shuffle(df, ["k"]).collect()] != list(range(1000))
    boot = sp.bootstrap_resample(df.select("k"), ["k"], 4).groupBy("replicate_id").agg(F.sum("copies").alias("n")).collect()
    assert [r["n"] for r in boot] == [1000] * 4
    mixed = sp.ratio_mix(df.where("label = 1"), df.where("label = 0"), ["k"], (7, 3))
    assert mixed.count() == 100 + 233
    assert sp.balanced_mix(df.where("label = 1"), df.where("label = 0"), ["k"]).count() == 200
    assert sp.fraction_mix(df.where("label = 1"), df.where("label = 0"), ["k"]).count() == 190
    val = sp.train_val_split(df, ["k"], 0.2013).where("part = 'val'").count()
    assert val == math.ceil(1000 * 0.2013)


def test_text_features_by_hand(spark):
    docs = spark.createDataFrame(
        [(1, "xxx yyy xxx", "dutch"), (2, "yyy zzz", "other"), (3, "a b", "dutch")], "doc_id INT, text STRING, lang STRING"
    )
    feats, vocab = ft.vectorize(docs, mindf=1)
    words = {r["term"]: (r["idx"], r["df"]) for r in vocab.collect()}
    assert words == {"xxx": (0, 1), "yyy": (1, 2), "zzz": (2, 1)}
    idf = {t: math.log(4 / (1 + d)) + 1 for t, (_, d) in words.items()}
    x, y = (1 + math.log(2)) * idf["xxx"], idf["yyy"]
    got = {(r["doc_id"], r["idx"]): r["w"] for r in feats.collect()}
    assert got[(1, 0)] == pytest.approx(x / math.hypot(x, y))
    assert got[(2, 3)] == 1.0 and (1, 3) not in got and not any(d == 3 for d, _ in got)
    fresh = spark.createDataFrame([(9, "zzz unknown zzz", "dutch")], docs.schema)
    new, _ = ft.vectorize(fresh, vocab)
    assert [(r["idx"], r["w"]) for r in new.collect()] == [(2, 1.0)]
    vectors = spark.createDataFrame([("xxx", [1.0, 0.0]), ("yyy", [0.0, 3.0])], "term STRING, vec ARRAY<FLOAT>")
    means = ft.mean_embedding(ft.term_counts(docs), docs, vectors)
    assert {r["doc_id"]: [round(v, 6) for v in r["embedding"]] for r in means.collect()} == {
        1: [0.666667, 1.0], 2: [0.0, 3.0], 3: [0.0, 0.0]
    }
    own = {(r["doc_id"], r["term"]) for r in ft.doc_feature_sets(ft.term_counts(docs), docs, 2).collect()}
    assert own == {(1, "yyy"), (2, "yyy"), (2, "")}


def test_linear_score_by_hand(spark):
    tf = spark.createDataFrame([(1, "good", 1), (1, "bad", 1), (2, "good", 2)], "doc_id INT, term STRING, tf BIGINT")
    docs = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.0)], "doc_id INT, language DOUBLE")
    model = spark.createDataFrame([("good", 1.0, 2.0), ("bad", 1.0, -1.0)], "term STRING, idf DOUBLE, coef DOUBLE")
    heads = spark.createDataFrame([(0.5, -0.25)], "intercept DOUBLE, language_coef DOUBLE")
    got = {r["doc_id"]: r["p"] for r in md.score_linear(tf, docs, model, heads).collect()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    assert got[1] == pytest.approx(sig(1 / math.sqrt(2) + 0.5))
    assert got[2] == pytest.approx(sig(2 - 0.25 + 0.5)) and got[3] == pytest.approx(sig(0.25))
    top = md.top_features(model.select("term", "coef"), 1)
    assert {(r["side"], r["term"]) for r in top.collect()} == {("positive", "good"), ("negative", "bad")}


def scores(spark, rows):
    return spark.createDataFrame(rows, "y INT, p DOUBLE")


def test_edge_scores(spark):
    edge = scores(spark, [(0, 0.0), (1, 1.0), (0, 0.5), (1, 0.5)])
    dens = {(r["cls"], r["bin"]): r["density"] for r in dn.density_sliding(edge).collect()}
    assert len(dens) == 2000 and all(v > 0 for v in dens.values())
    assert {r["bin"] for r in dn.density_hist(edge).collect()} == {0, 1, 2}
    row = mt.metric_bundle(edge).head()
    assert (row["acc"], row["auroc"]) == (0.75, 0.875)
    constant = scores(spark, [(0, 0.3), (1, 0.3), (1, 0.3)])
    row = mt.metric_bundle(constant).head()
    assert row["spcc"] == 0 and row["auroc"] == 0.5 and row["mcc"] == 0
    single = mt.metric_bundle(scores(spark, [(1, 0.7), (1, 0.2)])).head()
    assert single["auroc"] is None and single["spcc"] == 0 and single["ba"] == 0.5
    hist = mt.score_histogram(constant)
    assert hist.agg(F.sum("n")).head()[0] == 3 and hist.count() == 50
    best = mt.optimal_threshold(edge).head()
    assert 0 <= best["idx"] < 100 and best["opt"] == best["idx"] / 100
    assert [r["z"] for r in edge.select(sc.logit("p").alias("z")).orderBy("z").collect()] == [-math.inf, 0, 0, math.inf]


def test_logit_rule_for_hard_labels(spark):
    hard = scores(spark, [(0, 0.0), (1, 1.0), (1, 0.0), (0, 0.0)])
    assert mt.point_biserial(hard, logit=True).head()[0] == pytest.approx(mt.point_biserial(hard).head()[0])
    soft = scores(spark, [(0, 0.2), (1, 0.9), (1, 0.4)])
    want = soft.select(F.corr("y", sc.logit("p"))).head()[0]
    assert mt.point_biserial(soft, logit=True).head()[0] == pytest.approx(want)


def test_share_at_the_ends(spark):
    pair = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0)], "bin INT, dt DOUBLE, df DOUBLE")
    bin_ = dn.hist_bin("p", 2)
    for rows, want in (([(0, 0.1)] * 4, 1.0), ([(0, 0.9)] * 4, 0.0), ([(0, 0.1), (0, 0.9), (0, 0.8), (0, 0.7)], 0.25)):
        cells = cal.likelihood_cells(scores(spark, rows), pair, bin_=bin_)
        assert cal.prevalence_ml(cells).head()["pi"] == pytest.approx(want, abs=1e-9)
        assert cal.prevalence_points(cells).head()["pi"] == pytest.approx(want, abs=1e-9)
        assert cal.prevalence_grid(cells).head()["pi"] == pytest.approx(want)
    shares = spark.createDataFrame([(1.0, 4)], "pi DOUBLE, n BIGINT")
    rows = scores(spark, [(0, 0.4), (0, 0.1), (0, 0.3), (0, 0.2)])
    assert cal.calibrated_threshold(rows, shares).head()[0] == 0.1
    shares = spark.createDataFrame([(0.0, 4)], "pi DOUBLE, n BIGINT")
    assert cal.calibrated_threshold(rows, shares).head()[0] == 0.4


def test_require_columns(spark):
    good = scores(spark, [(1, 0.5)])
    assert cal.require_columns(good) is good
    for bad in (good.drop("p"), good.withColumn("p", F.lit("x")), good.drop("y")):
        with pytest.raises(ValueError):
            cal.require_columns(bad)


def test_nearest_rank_against_brute_force(spark, settings):
    import random

    rng = random.Random(3)
    s = [round(rng.random(), 2) for _ in range(300)]
    t = [round(rng.uniform(-0.3, 1.3), 3) for _ in range(200)]
    ordered = sorted(s)
    want = {x: min(range(300), key=lambda i: ((x - ordered[i]) * (x - ordered[i]), i)) for x in t}
    with settings(spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = dn.nearest_rank(
            spark.createDataFrame([(v,) for v in s], "s DOUBLE"), spark.createDataFrame([(v,) for v in t], "t DOUBLE")
        )
        assert {r["t"]: r["idx"] for r in got.collect()} == want


def test_chi2_cdf(spark):
    one = spark.createDataFrame([(7.8147, 0.95), (0.0, 0.0), (1e7, 1.0), (2.366, 0.5)], "x DOUBLE, want DOUBLE")
    for r in one.select("want", sc.chi2_cdf("x", 3).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-4)


def test_drift_of_a_perfect_mixture(spark):
    pair = spark.createDataFrame([(0, 0.2, 0.6), (1, 0.8, 0.4)], "bin INT, dt DOUBLE, df DOUBLE")
    batch = scores(spark, [(0, 0.1)] * 4 + [(0, 0.9)] * 6)
    shares = spark.createDataFrame([(0.5, 10)], "pi DOUBLE, n BIGINT")
    row = drift.compare_distributions(drift.mixture_histogram(batch, pair, shares, bins=2), bins=2).head()
    assert row["ks"] == pytest.approx(0) and row["dkl"] == pytest.approx(0) and row["chi2"] == pytest.approx(0)


def test_votes_by_hand(spark):
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d")], "doc_id INT, term STRING")
    members = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c")], "member_id INT, term STRING")
    pairs = spark.createDataFrame([(d, m) for d in (1, 2, 3) for m in (0, 1)], "doc_id INT, member_id INT")
    w = vt.overlap_weights(terms, materialize(vt.members_by_term(members)), pairs)
    got = {(r[0], r[1]): r[2] for r in w.collect()}
    assert got == pytest.approx({(1, 0): 1.0, (1, 1): 0.5, (2, 0): 1 / 3, (2, 1): 2 / 3, (3, 0): 0.0, (3, 1): 0.0})
    acc = spark.createDataFrame([(0, 0.5), (1, 1.0)], "member_id INT, accuracy DOUBLE")
    after = {(r[0], r[1]): r[2] for r in vt.normalize_weights(w, acc, "after").collect()}
    assert after[(1, 0)] == pytest.approx(0.5) and after[(1, 1)] == pytest.approx(0.5) and after[(3, 0)] == 0
    before = {(r[0], r[1]): r[2] for r in vt.normalize_weights(w, acc, "before").collect()}
    assert before[(1, 0)] == pytest.approx(1 / 3) and before[(1, 1)] == pytest.approx(1 / 3)
    preds = pairs.withColumn("pred", F.col("member_id").cast("double"))
    vote = vt.weighted_vote(vt.normalize_weights(w, acc, "after"), preds, threshold=0.5)
    assert {r[0]: r[1] for r in vote.collect()} == {1: True, 2: True, 3: False}
    bag = vt.bagged_vote(preds, ["doc_id"], threshold=0.5)
    assert {r[0]: r[1] for r in bag.collect()} == {1: True, 2: True, 3: True}


def test_multiclass_equals_binary_correlation(spark):
    rows = [(i, i % 3, c, ((i * 7 + c * 3) % 11) / 11 + (i % 3 == c)) for i in range(60) for c in range(3)]
    long = spark.createDataFrame(rows, "row INT, true_cls INT, cls INT, score DOUBLE")
    pairs = {(r["i"], r["j"]): r["rho"] for r in mc.rho_ovo_pairs(long).collect()}
    assert len(pairs) == 6
    sub = long.where("cls = 0 AND true_cls IN (0, 1)")
    want = sub.select(F.corr("score", (F.col("true_cls") == 0).cast("double"))).head()[0]
    assert pairs[(0, 1)] == pytest.approx(want)
    rest = {r["i"]: r["rho"] for r in mc.rho_ovr_classes(long).collect()}
    want = long.where("cls = 2").select(F.corr("score", (F.col("true_cls") == 2).cast("double"))).head()[0]
    assert rest[2] == pytest.approx(want)


def test_terms_of_many_scripts(spark):
    df = spark.createDataFrame([("ΑΒΓ déjà_vu 漢字仮名 no-ab 12 345",)], "text STRING")
    assert df.select(tx.terms("text")).head()[0] == ["αβγ", "déjà_vu", "漢字仮名", "345"]


def test_missing_scores_take_no_part(spark):
    from sharewise.operators import density, metrics

    rows = [(i % 2, i / 20) for i in range(20)]
    schema = "y int, p double"
    whole = spark.createDataFrame(rows, schema)
    gaps = spark.createDataFrame(rows + [(1, None), (0, None), (0, None)], schema)
    for f in (metrics.metric_bundle, metrics.point_biserial, metrics.threshold_sweep, metrics.score_histogram, density.density_hist, density.density_sliding):
        got, want = (
            sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(rows_).collect()) for rows_ in (gaps, whole)
        )
        assert got == want
    wide = spark.createDataFrame([(1, -0.5), (1, 1.5), (0, 0.5)], schema)
    assert density.density_sliding(wide).count() == 2000


def test_rows_without_a_state_stay(spark):
    from sharewise.operators import calibration

    rows = spark.createDataFrame([("a", 0.7), ("b", 0.7)], "k string, p double")
    state = spark.createDataFrame([("a", 0.5)], "k string, threshold double")
    got = {r.k: r.cal_label for r in calibration.predict_calibrated(rows, state, ["k"]).collect()}
    assert got == {"a": True, "b": None}


def test_samples_of_empty_pools_and_null_strata(spark):
    from sharewise.operators import sampling

    with pytest.raises(ValueError):
        sampling.sample_n(spark.createDataFrame([], "id long"), ["id"], 5)
    rows = spark.createDataFrame([(i, None if i < 10 else "s") for i in range(20)], "id long, s string")
    got = sampling.sample_n(rows, ["id"], 4, strata=["s"]).groupBy("s").count().collect()
    assert sorted(r["count"] for r in got) == [4, 4]
