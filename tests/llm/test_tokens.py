"""Byte-level BPE against the tokenizer library, fingerprints and backoff against brute force."""

import random
import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from helpers import frame, prose, texts

from sharewise.llm import backoff, bpe, fingerprints
from sharewise.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary()[0]), special_tokens={}
    )


def test_query_encodes_as_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_replay_with_ranks_that_come_late():
    # "abc" ranks below "ab", so a join can make a pair of a lower rank.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"cab": 257, b"ab": 258, b"ca": 259, b"aa": 260}

    def alone(word):
        parts = [bytes([b]) for b in word]
        if word in ranks:
            return [ranks[word]]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("abc"), draw.integers(0, 12))).encode() for _ in range(400)]
    packed = bpe.replay(words, ranks, bpe.pairs_of(ranks))
    assert [np.frombuffer(p, "<i4").tolist() for p in packed] == [alone(w) for w in words]


def test_very_long_words_merge_as_in_the_library(library):
    draw = np.random.default_rng(2)
    words = [b"a" * 20_000, b"the" * 5000, "".join(draw.choice(list("abcdefgh"), 30_000)).encode(), "漢字".encode() * 3000]
    ranks, pairs = bpe.load_ranks(vocabulary()[0]), bpe.load_pairs(vocabulary()[0])
    for word, packed in zip(words, bpe.replay(words, ranks, pairs), strict=True):
        assert np.frombuffer(packed, "<i4").tolist() == library._core_bpe.encode_single_piece(word)


def test_awkward_texts_round_trip(spark, library):
    path, pattern = vocabulary()
    docs = frame(spark)
    rows = bpe.decode(bpe.encode(docs, path, pattern), path).collect()
    assert len(rows) == docs.count()
    every = texts()
    for r in rows:
        text = every[r.doc_id] or ""
        assert r.text.decode() == text and r.n_tokens == len(library.encode_ordinary(text))
    assert bpe.encode(frame(spark, []), path, pattern).count() == 0


def neighbours(rows):
    """(doc_id, edited text) by descending doc_id."""
    rows = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + after[:half], after


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_texts_and_likeness(spark, sf_dir, settings, partitions):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    with settings(spark__sql__shuffle__partitions=str(partitions)):
        rows = {r.doc_id: r for r in QUERIES["op8_minhash"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for i, text, edited, _ in neighbours([(r.doc_id, r.text) for r in docs]):
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        one, two = fingerprints._shingles(text), fingerprints._shingles(edited)
        assert abs(r.near_edited - len(one & two) / max(1, len(one | two))) < 0.2 or not (one | two)


def test_fingerprints_of_awkward_rows(spark):
    docs = frame(spark)
    rows = fingerprints.edited_neighbours(spark, docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint
    assert by[16].fingerprint == by[17].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.edited_neighbours(spark, frame(spark, [])).count() == 0
    assert fingerprints.edited_neighbours(spark, frame(spark, ["only one"]).dropDuplicates()).head().near_next == 1.0


def test_bands_find_near_copies(spark):
    base = prose(11, 400)
    docs = frame(spark, [base, base.replace("alpha1", "other", 1), prose(12, 400), base])
    links = fingerprints.near_links(spark, docs).collect()
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert {(r.a, r.b) for r in links} == {tuple(sorted((prints[0], prints[1])))}
    groups = {r.doc_id: r.group for r in fingerprints.near_groups(spark, docs).collect()}
    assert groups[0] == groups[1] == groups[3] != groups[2]


def plain_backoff(rows, order, alpha):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every, size = sum(grams, Counter()), sum(map(len, words))
    for (i, _), w, own in zip(rows, words, grams, strict=True):
        def count(g, own=own):
            return every[g] - own[g]

        def s(g, n=size - len(w)):
            if len(g) == 1:
                return count(g) / n if count(g) else alpha / (n + 1)
            return count(g) / count(g[:-1]) if count(g) else alpha * s(g[1:])

        yield i, len(w), sum(math.log(s(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(len(w)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_plain_counts(spark, sf_dir, order):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in backoff.score(docs, order=order, batch_bytes=50_000).collect()}
    assert len(got) == len(rows)
    for i, n, log in plain_backoff(rows, order, backoff.ALPHA):
        assert got[i].n_words == n and got[i].log_score == pytest.approx(log, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("bits", [3, 20, 47, 64])
def test_packed_hashes_come_back(bits):
    rng = np.random.default_rng(bits)
    for size in (1, 2, 5000):
        hashes = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False) >> np.uint64(64 - bits))
        counts = rng.integers(1, 2**31, len(hashes))
        back, n = backoff._unpack(backoff._pack(hashes, counts))
        assert (back == hashes).all() and (n == counts).all()
    ends = np.array([0, 1, 2**64 - 1], np.uint64)
    back, n = backoff._unpack(backoff._pack(ends, np.array([1, 2, 2**32 - 1])))
    assert (back == ends).all() and n.tolist() == [1, 2, 2**32 - 1]


def test_backoff_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(backoff, "PART_ENTRIES", 1000)
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = backoff.score(docs, batch_bytes=5000).collect()
    want = sorted((i, n, round(x, 6)) for i, n, x in plain_backoff(rows, backoff.ORDER, backoff.ALPHA))
    assert sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert backoff.score(frame(spark, [])).count() == 0


def test_bands_keep_a_star_of_edited_copies(spark):
    """Copies edited on their own, linked mostly through the original; groups as from all pairs."""
    draw = random.Random(7)
    words = [f"w{draw.randint(0, 9999)}" for _ in range(504)]
    rows = [(0, " ".join(words))]
    for i in range(1, 121):
        own = list(words)
        for k in range(6):
            own[k * 84 + draw.randrange(78)] = f"own{draw.random()}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len({r.group for r in fingerprints.near_groups(spark, docs).collect()}) == 1


def test_vocabularies_beyond_sixteen_bits_are_refused():
    with pytest.raises(ValueError):
        bpe.pairs_of({b"a": 1, b"b": 70_000})
