"""Quality, mixing, licenses, archives, search and the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from helpers import frame, texts
from pyspark.sql import functions as F

import corpus_pipeline
from sharewise.llm import licenses, mixing, quality, topk, warc
from sharewise.llm.queries import ORACLES, QUERIES

LABELS = "doc_id long, quality int, toxic int"


def test_quality_keeps_good_texts_and_drops_others(spark):
    sf_dir = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in QUERIES["op1_importance_resampling"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_quality_of_awkward_rows(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], LABELS)
    assert quality.select(docs, none).count() == docs.count()
    labels = spark.createDataFrame([(9, 1, 0), (16, 1, 0), (6, 0, 0), (None, 1, 0), (99, 1, 1)], LABELS)
    rows = quality.select_rows(spark, docs, labels)
    assert rows.columns == docs.columns
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in quality.select(docs, labels).collect()}
    assert quality.select(frame(spark, []), labels).count() == 0
    assert quality.select(docs, labels, k=5).count() >= 5


def test_gumbel_cut_is_exact(spark):
    keys = [int(x) for x in np.random.default_rng(2).integers(-(2**62), 2**62, 500)] + [17] * 5
    scored = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 3, 250, 505):
        assert quality.cut_key(scored, k) == sorted(keys, reverse=True)[k - 1]
    order = quality._sortable(np.array([-math.inf, -2.5, -0.0, 1e-9, 3.0]))
    assert (np.diff(order) > 0).all()


def plain_targets(rows):
    sizes = {}
    for source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else weight[s] * left / free for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return sizes, target
        full |= over


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_meets_its_targets(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs, block).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, target = plain_targets([(r.source, r.text) for r in docs.collect()])
    assert len(rows) == docs.count()
    own = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        own.setdefault(s, []).append(r.size)
    for s in sizes:
        taken = sum(r.taken for r in rows if source[r.doc_id] == s)
        assert abs(taken - target[s]) <= max(0.02 * target[s], 2 * np.median(own[s]))
    again = mixing.mix(docs.repartition(7), block).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


@pytest.mark.parametrize("block", [128, 4096])
def test_each_source_comes_near_its_target(spark, block):
    """Also where a source is many blocks, and where one text outweighs the target."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    heavy = spark.createDataFrame([(10**6 + i, "w " * (4000 if i == 0 else 1 + i % 40), "heavy") for i in range(200)], docs.schema)
    both = docs.unionByName(heavy)
    rows = mixing.mix(both, block).join(both.select("doc_id", "source"), "doc_id")
    sums = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.median("size").alias("median"))
    for r in sums.collect():
        assert abs(r.taken - r.target) <= max(0.005 * r.target, 2 * r.median)


def test_cube_is_fair_and_balanced():
    import random

    size, chance = [5, 9, 1, 1, 30, 7, 2, 8], [0.4] * 8
    hits = np.zeros(8)
    for seed in range(4000):
        draw = random.Random(seed)
        flown = mixing.fly(chance, size, draw)
        assert sum(0 < p < 1 for p in flown) <= 2
        assert sum(flown) == pytest.approx(3.2) and np.dot(flown, size) == pytest.approx(0.4 * sum(size))
        hits += mixing.land(flown, size, draw)
    assert np.abs(hits / 4000 - 0.4).max() < 0.04


def test_mix_of_awkward_rows(spark):
    docs = frame(spark)
    rows = mixing.mix(docs, 4).collect()
    assert len(rows) == docs.count()
    copies = sum(r.copies for r in rows)
    mixed = mixing.mix_rows(docs, 4)
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert mixing.mix(frame(spark, [])).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(frame(spark, ["", None, " "])).collect())


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(text):
    own = words(text)
    out = []
    for notice in licenses.NOTICES:
        if notice.base:
            phrase = notice.phrase.split()
            out += [(i, notice.label) for i in range(len(own)) if own[i : i + len(phrase)] == phrase]
    return len(own), sorted(out)


def check_scan(found, by_id):
    for r in found:
        n, base = plain_base(by_id[r.doc_id])
        got = sorted((s.first_word, s.label) for s in r.spans if s.base)
        assert (r.n_words, got) == (n, base)


def test_license_query_has_every_base_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_id = {r.doc_id: r.text for r in docs.collect()}
    check_scan(licenses.scan(docs).collect(), by_id)
    rows = QUERIES["op5_license_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(by_id)
    for r in rows:
        n, base = plain_base(by_id[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(base))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None)) and 0 <= r.score <= 1


def test_license_edits(spark):
    cases = {
        "under the MIT lisence": ["mit"], "Under teh MIT license!": ["mit"], "under the BSD license": [], "apache licence version 2": ["apache-2"],
        "apache license version 3": [], "cc by nd": [], "CC-BY-NC cc by nc": ["cc-by-nc", "cc-by-nc"], "thunder the mit licenses": [],
        "under the mit license under the mit license": ["mit", "mit"], "gnu general public license, version 3": ["gpl-3"],
        "apache license version 2 version 2": ["apache-2"],
    }
    rows = list(enumerate(cases))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {rows[r.doc_id][1]: [s.label for s in r.spans] for r in found} == cases
    awkward = frame(spark)
    check_scan(licenses.scan(awkward).collect(), dict(enumerate(texts())))
    assert licenses.scan(frame(spark, [])).count() == 0


PAGES = "page_id long, url string, html string, digest string, refers_to string, offset int, folder string"


def test_archives_give_back_every_page(spark, tmp_path):
    big = "<p>é" * 100
    rows = [(5, "http://a/\r\n x", big), (3, "http://b", big), (9, None, big), (None, "u", big), (1, "u", "short"), (2, "u", "short"),
            (4, "u", None), (6, "u", ""), (7, "u", "z" * 200_000), (3, "http://b", big), (8, "u", "\r\n\r\n" * 60)]
    pages = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], PAGES)
    index = warc.write(spark, pages, f"file://{tmp_path}/archives")
    got = {}
    for r in warc.read(index).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert {(r.record_type, r.refers_to) for r in got[3]} == {("response", None)}
    for i in (5, 9, None):
        assert [(r.record_type, r.refers_to, r.payload) for r in got[i]] == [("revisit", 3, None)]
    for page, _, html in rows:
        raw = (html or "").encode()
        for r in got[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert r.payload is None or bytes(r.payload) == raw
    some = warc.read(index, F.col("url") == "u").collect()
    assert len(some) == 7
    assert warc.read(warc.write(spark, spark.createDataFrame([], PAGES))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def plain_topk(vectors, queries, k):
    out = []
    for q in queries:
        own = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(vectors[q], v, strict=True)))), i)
               for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(own)[:k])]
    return sorted(out)


def test_search_with_ties_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 3)]) for i in range(60)]
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [math.nan, 0.0, 0.0]), (103, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (104, [1.0]), (110, [2.0, 2.0])]
    vectors |= {104: [256], 110: [512, 512]}
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, dim int, block int")
    got = topk.search(table, F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, got)) == plain_topk(vectors, [i for i in vectors if i % 10 == 0], 5)
    huge = spark.createDataFrame([(i, [3e30 * s, 1.0]) for i, s in enumerate((1, 1, -1))], "vec_id long, embedding array<double>")
    limits = {i: [(2**63 - 1) * s if s > 0 else -(2**63), 256] for i, s in enumerate((1, 1, -1))}
    assert sorted(map(tuple, topk.search(huge, F.lit(True), 5).collect())) == plain_topk(limits, [0, 1, 2], 5)
    assert topk.search(table.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = corpus_pipeline.STAGES
    for _, stage in stages[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() > 0
    tokens = stages[-1][1](spark, docs, sf_dir)
    assert tokens.count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_pipeline_stages_take_empty_and_awkward_documents(spark, sf_dir):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in ([], None):
        docs = frame(spark, rows).select(names)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).count()


def plain_edits(one, two):
    row = list(range(len(two) + 1))
    for i, x in enumerate(one, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(two, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_places_against_all_runs_of_words():
    """Every edited place is reported or overlaps one with as few edits; nothing else is reported."""
    draw, dense = random.Random(9), ["bsd 3 claus licence and bsd 2 clause license"]
    for _ in range(30):
        parts = []
        for notice in draw.choices(licenses.NOTICES, k=5):
            phrase = list(notice.phrase)
            for _ in range(draw.randint(0, 3)):
                phrase[draw.randrange(len(phrase))] = draw.choice(["", "x", "ee", " "])
            parts.append("".join(phrase))
        dense.append(" ".join(" ".join(parts).split()))
    assert [licenses.NOTICES[p[0]].label for p in licenses.places(dense[0])] == ["bsd-3-clause", "bsd-2-clause"]
    for text in dense:
        got = licenses.places(text)
        starts = [m.start() for m in re.finditer(r"[^ ]+", text)]
        ends = [m.end() for m in re.finditer(r"[^ ]+", text)]
        for number, notice in enumerate(licenses.NOTICES):
            every = {}
            for a in starts:
                for b in ends:
                    if abs(b - a - len(notice.phrase)) <= notice.edits:
                        cost = plain_edits(notice.phrase, text[a:b])
                        if cost == 0 or cost <= notice.edits and set(notice.telling) <= set(text[a:b].split()):
                            every[a, b] = cost
            own = {(a, b): cost for n, a, b, cost in got if n == number}
            assert own.items() <= every.items()
            for (a, b), cost in every.items():
                assert any(x < b and a < y and c <= cost for (x, y), c in own.items())
