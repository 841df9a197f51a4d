"""What a job leaves on disk while it goes on: no shuffle files of steps that have ended, no tables that nothing reads."""

import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_models import newton

from sharewise.operators import features as ft
from sharewise.operators import joint
from sharewise.operators import models as md
from sharewise.plans import discard, materialize, store
from sharewise.plans.state import checkpoint_root


def shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString("\n")
    return {x for x in blocks.split("\n") if x.startswith("shuffle_")}


def left(spark, files):
    """The number of other shuffle files, once it stands still: they are deleted in the background."""
    n, now = None, len(shuffle_files(spark) - files)
    while n != now:
        time.sleep(0.3)
        n, now = now, len(shuffle_files(spark) - files)
    return n


def tables(spark):
    return {p.name for p in Path(re.sub("^file:/*", "/", checkpoint_root(spark))).iterdir()}


def kinds(names):
    return sorted(re.sub(r"-.*|\d", "", n) for n in names)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = (rng.random((240, 30)) < 0.3) * rng.uniform(0.1, 1, (240, 30))
    y = (rng.random(240) < 1 / (1 + np.exp(-(x @ rng.normal(size=30) * 3 - 0.5)))).astype(float)
    rows = [(i, int(i % 3), float(b), [(int(j), float(a[j])) for j in np.nonzero(a)[0]]) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, store(spark.createDataFrame(rows, "doc_id long, fold int, label double, entries array<struct<idx:int,w:double>>"))


def test_steps_of_a_fit_leave_no_files(spark, monkeypatch, data):
    """However many steps: their shuffles and points are gone when the fit has ended, and few points are kept during it."""
    x, y, df = data
    monkeypatch.setattr(joint, "SHARED_ENTRIES", 300)
    files, folders, most, taken = shuffle_files(spark), tables(spark), [], []
    step = joint._step

    def watched(*a):
        taken.append(1)
        most.append(left(spark, files))
        return step(*a)

    monkeypatch.setattr(joint, "_step", watched)
    weighted = df.select("fold", "label", F.lit(1.0).alias("weight"), "entries")
    coefs, intercepts = joint.fit_joint(weighted, {r: 30 for r in range(4)}, piece=8, held="fold")
    found = {(r["run_id"], r["idx"]): r["coef"] for r in coefs.collect()}
    heads = {r["run_id"]: r["intercept"] for r in intercepts.collect()}
    for r in range(4):
        own = np.arange(240) % 3 != r
        want = newton(x[own], y[own], np.ones(own.sum()))
        assert np.abs(np.r_[heads[r], [found[r, j] for j in range(30)]] - want).max() < 1e-4
    # What the first counts left, and no more from then on.
    assert len(taken) > 12 and max(most) <= most[0] and left(spark, files) <= most[0]
    points = tables(spark) - folders
    assert kinds(n for n in points if not re.fullmatch(r"[0-9a-f-]{36}", n)) == ["coefficients", "pieces"]
    root = Path(re.sub("^file:/*", "/", checkpoint_root(spark)))
    assert not [p for n in points for p in (root / n).glob("rdd-*")] and not list(root.glob("rdd-*"))


def test_class_weights_share_the_rows(spark, monkeypatch, data):
    """A fit for every class weight keeps the rows once; each is the optimum of its own weights."""
    x, y, df = data
    folders, shared = tables(spark), []
    fit = md.fit_joint
    monkeypatch.setattr(md, "fit_joint", lambda rows, *a, **b: shared.append(rows.count()) or fit(rows, *a, **b))
    coefs, intercepts = md.fit_entries(df, 30, [1.0, 4.0, 25.0])
    assert shared == [240] and "weighted" not in kinds(tables(spark) - folders)
    found = {(r["run_id"], r["idx"]): r["coef"] for r in coefs.collect()}
    heads = {r["run_id"]: r["intercept"] for r in intercepts.collect()}
    for r, w in enumerate([1.0, 4.0, 25.0]):
        want = newton(x, y, np.where(y == 1, w, 1.0))
        assert np.abs(np.r_[heads[r], [found[r, j] for j in range(30)]] - want).max() < 1e-4
    with pytest.raises(ValueError):
        md.fit_entries(df.withColumn("label", F.lit(2.0)), 30)


def test_written_tables_leave_no_shuffle_files(spark):
    files, folders = shuffle_files(spark), tables(spark)
    df = spark.range(1000).groupBy((F.col("id") % 70).alias("k")).count()
    kept, small = store(df, "kept"), materialize(df)
    assert left(spark, files) == 0
    assert kept.exceptAll(small).count() == 0 and small.count() == df.count() == 70
    discard(kept)
    assert "kept" not in kinds(tables(spark) - folders)
    with pytest.raises(ValueError):
        discard(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_runs_leave_no_entries(spark):
    """The rows and lists that only the fit of the runs reads are gone when it has ended."""
    docs = spark.range(80).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * (k + 2) % 7).cast("string")) for k in range(4)]).alias("text"), F.lit("nl").alias("lang")
    )
    corpus = ft.corpus_terms(docs)
    rows = docs.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("run_id"), "doc_id").select(
        "run_id", "doc_id", (F.col("doc_id") % 3 == 0).cast("double").alias("label"), F.lit(1).cast("long").alias("copies")
    )
    folders = tables(spark)
    fitted = md.fit_runs(corpus, rows, [0, 1], mindf=2)
    left = kinds(n for n in tables(spark) - folders if not re.fullmatch(r"[0-9a-f-]{36}", n))
    assert "entries" not in left and "assigned" not in left
    assert fitted.pair.count() > 0 and md.score_runs(corpus, rows, fitted).count() == 160


def test_term_rows_reach_the_tiles_packed(spark, monkeypatch):
    """A group's term rows are a few compressed lists: what is shuffled is a fraction of a row each, and every row arrives."""
    monkeypatch.setattr(ft, "VECTOR_TILE_BYTES", 2000)
    tf = store(spark.range(20000).select(F.floor(F.col("id") / 40).alias("doc_id"), F.concat(F.lit("word"), F.col("id") * 7 % 211).alias("term"), (F.col("id") % 3 + 1).alias("tf")))
    vectors = store(spark.range(150).select(F.concat(F.lit("word"), "id").alias("term"), F.array(*[((F.col("id") * k) % 17).cast("float") for k in (2, 3)]).alias("vec")))
    want = {r[0]: [r[1], r[2]] for r in tf.join(vectors, "term").groupBy("doc_id").agg(*[F.sum(F.col("tf") * F.col("vec")[k]) / F.sum("tf") for k in (0, 1)]).collect()}
    means = ft.mean_embedding(tf, spark.range(500).select(F.col("id").alias("doc_id")), vectors)
    got = {r["doc_id"]: r["embedding"] for r in means.collect()}
    assert len(got) == 500 and all(got[d] == pytest.approx(want[d]) for d in want)
    batch = pa.RecordBatch.from_pydict({"_group": [k % 3 for k in range(9000)], "_id": [k // 90 for k in range(9000)], "term": [f"word{k % 70}" for k in range(9000)], "_w": [1.0] * 9000})
    parts = list(ft._packed_groups(iter([batch, batch])))
    assert [p["_group"][0].as_py() for p in parts] == [0, 1, 2] and sum(p.nbytes for p in parts) < 18000 * 8
    rows = [pa.ipc.open_stream(p["rows"][0].as_py()).read_all() for p in parts]
    assert sum(r.num_rows for r in rows) == 18000 and rows[1]["_id"].to_pylist() == [k // 90 for k in range(9000) if k % 3 == 1] * 2
    assert list(ft._packed_groups(iter([]))) == []
