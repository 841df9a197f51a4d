"""Suffix removal and SimHash against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import frame, prose, texts
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sharewise.llm import induced, lists, near, simhash, suffix
from sharewise.llm.queries import QUERIES


def plain_repeats(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    often = Counter(raw[p : p + length] for _, raw in raws for p in range(len(raw) - length + 1))
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if often[raw[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        yield i, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()


def found(rows):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.mark.parametrize("memory", [10**9, 9])
def test_induction_against_plain_counts(memory):
    draw = np.random.default_rng(3)
    for _ in range(300):
        text = draw.integers(0, draw.integers(1, 5), draw.integers(1, 100))
        if draw.random() < 0.3:
            text = np.tile(text, 4)
        cap = int(draw.integers(1, 9))
        parts = [tuple(text[i : i + cap]) for i in range(len(text) - cap + 1)]
        often = Counter(parts)
        want = [often[p] > 1 for p in parts] + [False] * (len(text) - len(parts))
        assert induced.repeated(text, cap, memory=memory).tolist() == want or len(text) <= cap


def test_query_against_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted(plain_repeats([(r.doc_id, r.text) for r in docs], suffix.LENGTH))
    assert found(QUERIES["op6_suffix_dedup"](spark, sf_dir).collect()) == want
    assert any(w[2] for w in want)


@pytest.mark.parametrize("hot", [2048, 1])
def test_awkward_rows_lose_their_repeats(spark, hot):
    docs = frame(spark)
    want = sorted(plain_repeats([(r.doc_id, r.text) for r in docs.collect()], 200))
    got = suffix.remove(docs, length=200, gram=32, shard_bytes=20_000, hot_segments=hot).collect()
    assert found(got) == want
    assert suffix.remove(frame(spark, [])).count() == 0


def test_rows_keep_their_columns(spark):
    docs = frame(spark)
    cut = suffix.remove_rows(docs, length=200)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[0].text is None and rows[7].text == rows[16].text == "" and rows[9].n_chars == len(rows[9].text)


def plain_passages(rows, length):
    """Texts without the runs of ``length`` words that also start elsewhere, from first to last byte of a word."""
    words = {i: [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^ \t-\r]+", (t or "").encode())] for i, t in rows}
    strings = lambda w: [tuple(x[2] for x in w[p : p + length]) for p in range(len(w) - length + 1)]
    often = Counter(s for w in words.values() for s in strings(w))
    out = {}
    for i, t in rows:
        gone = sorted({p + k for p, s in enumerate(strings(words[i])) if often[s] > 1 for k in range(length)})
        raw = bytearray((t or "").encode())
        keep = np.ones(len(raw), bool)
        for p in gone:
            after = words[i][p + 1][0] if p + 1 in set(gone) else words[i][p][1]
            keep[words[i][p][0] : after] = False
        out[i] = bytes(np.frombuffer(bytes(raw), np.uint8)[keep]).decode()
    return out


@pytest.mark.parametrize("options", [{}, {"hot_segments": 1}, {"shard_bytes": 2000}])
def test_passages_of_short_words(spark, options):
    """51 words of one letter take 101 bytes; fifty words of many bytes are no passage."""
    draw = random.Random(3)
    short = [" ".join(draw.choice("abcdefghij") for _ in range(n)) for n in (51, 50)]
    long = " ".join(f"word{draw.randint(0, 999):020d}" for _ in range(50))
    rows = [f"{prose(40 + k, 30)} {p}  {prose(60 + k, 30)}" for k, p in enumerate([*short, *short, long, long])]
    rows += [short[0].replace(" ", "\n"), *texts()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text or "" for r in suffix.remove_rows(docs, words=True, length=51, gram=16, **options).collect()}
    want = plain_passages(list(enumerate(rows)), 51)
    assert got == want
    assert short[0] not in got[0] + got[2] and short[1] in got[1] and long in got[4]


def plain_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(items, alike):
    """The smallest id that each id reaches over pairs that are alike."""
    parent = {i: i for i, _ in items}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(items):
        for j, y in items[:k]:
            if alike(x, y) and top(i) != top(j):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in parent}


def plain_components(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    found = plain_groups(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    return sorted((i, f"{x:016x}", found[i]) for i, x in prints)


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(rows):
    alike = lambda x, y: not x | y or len(x & y) >= 0.8 * len(x | y)
    return plain_groups([(i, plain_shingles(t)) for i, t in rows], alike)


def edited(words, at, step):
    """Words of which each ``step``-th from ``at`` on is another."""
    return " ".join(f"new{at}" if k % step == at else w for k, w in enumerate(words))


def test_near_copies_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.component_id for r in near.components_of(docs).collect()}
    assert rows == plain_near([(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_in_large_groups_and_awkward_rows(spark):
    """One large group of copies that differ from the first at most, chains, and texts just too far apart."""
    body = prose(11, 300).split()
    group = [edited(body, at, 300) for at in range(80)]
    chain = [" ".join(body[:100] + [f"a{k}" for k in range(5 * n)] + body[100 + 5 * n : 200]) for n in range(8)]
    far = [edited(prose(12, 200).split(), at, 30) for at in range(3)]
    rows = [*texts(), *group, *chain, *far, *group[:5], None]
    docs = frame(spark, rows)
    found = near.components_of(docs)
    plain = plain_near([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in found.collect()} == plain
    assert len({plain[i] for i, t in enumerate(rows) if t in group}) == 1
    kept = simhash.keep_one(docs, found)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain.values()))
    assert near.components_of(frame(spark, [])).count() == 0
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(unnamed, near.components_of(unnamed)).count() == docs.count()


def replaced(words, draw, places):
    """Words of which so many, far from one another, are others of their own."""
    gap = len(words) // places
    out = list(words)
    for k in range(places):
        out[k * gap + draw.randrange(gap - 5)] = f"own{draw.random()}"
    return " ".join(out)


def test_a_star_of_copies_each_edited_on_its_own(spark):
    """Copy to original 0.89, copy to copy 0.79: most copies are linked only through the original."""
    draw = random.Random(7)
    words = [f"w{draw.randint(0, 9999)}" for _ in range(504)]
    rows = [(i, replaced(words, draw, 6) if i else " ".join(words)) for i in range(1001)]
    found = near.components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 1001


def test_edited_copies_without_their_original(spark, monkeypatch):
    draw = random.Random(8)
    words = [f"w{draw.randint(0, 9999)}" for _ in range(504)]
    rows = [(i, replaced(words, draw, 6)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few, block in ((16, 1024), (1000, 20)):  # pivots first; all pairs at once, in small cells
        monkeypatch.setattr(lists, "FEW_PAIRS", few)
        monkeypatch.setattr(lists, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in near.components_of(docs).collect()} == plain_near(rows)


def test_simhash_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = QUERIES["op7_simhash"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == plain_components([(r.doc_id, r.text) for r in docs])


def test_simhash_of_awkward_rows(spark):
    docs = frame(spark)
    rows = simhash.components_of(docs).select("doc_id", simhash.hexadecimal("fp"), "component_id").collect()
    assert sorted(map(tuple, rows)) == plain_components([(r.doc_id, r.text) for r in docs.collect()])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_components(list(enumerate(texts())))})
    assert simhash.components_of(frame(spark, [])).count() == 0


def test_one_copy_stays_where_texts_share_an_id(spark):
    """Unrelated texts with one doc_id stay each; copies go by their text, not by their doc_id."""
    one, two, three = prose(41, 80), prose(42, 80), prose(43, 80)
    rows = [(1, one), (1, two), (2, three), (3, one), (4, two), (4, "only here " + prose(44, 60)), (5, three), (5, three), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()))
    assert kept == sorted([(0, one), (1, one), (1, two), (2, three), (4, rows[5][1])])
    twice = docs.where("doc_id = 5").withColumn("n_chars", F.lit(9))
    assert simhash.keep_one(twice).count() == 1


def test_links_keep_every_connection(spark):
    """A ball of prints a bit or two apart, in one long posting list, and chains between balls."""
    draw = np.random.default_rng(5)
    prints = {int(x) for x in draw.integers(0, 1 << 63, 40)}
    for x in list(prints)[:10]:
        for _ in range(60):
            a, b = draw.integers(0, 64, 2)
            prints.add(x ^ (1 << int(a)) ^ (1 << int(b)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)

    def groups(pairs):
        parent = {s: s for s in signed}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[top(a)] = top(b)
        return {frozenset(x for x in signed if top(x) == t) for t in set(map(top, signed))}

    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert groups([(r.a, r.b) for r in links]) == groups(near)
    assert prose(1, 3) == prose(1, 3)
