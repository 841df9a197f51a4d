"""Hard negatives, packing and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from helpers import frame, texts
from pyspark.sql import functions as F

from sharewise.llm import fill_in_middle as fim
from sharewise.llm import hard_negatives, packing, topk
from sharewise.llm.queries import ORACLES, QUERIES, json_vocabulary

VECTORS = "vec_id long, embedding array<float>, label int, score long, row long, v string, slot int"


def twin(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(ORACLES[name]).fetchall()


# --- hard negatives ---------------------------------------------------------------------


def vectors(n=260, dim=4, seed=3):
    """Ties, a hot vector, repeated ids, nulls and non-finite components; names that clash."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        v = [float(draw.randint(-3, 6)) / 4 for _ in range(dim)]
        if i % 3 == 0:
            v = [0.5, 0.25, 1.0, -0.5]
        rows.append([i, v, draw.choice([0, 0, 0, 1, 2, None])])
    rows[7][1], rows[8][1], rows[9][1] = None, [0.1, None, 0.2, 0.3], [0.1, math.inf, 0.2, math.nan]
    rows += [[50, [1.0, 1.0, 1.0, 1.0], 1], [50, [1.0, 1.0, 1.0, 1.0], 1], [100, [-1.0, -1.0, -1.0, -1.0], 2], [3, [0.5, 0.25, 1.0, -0.5], 1]]
    rows += [[150, [0.25, 0.25], 0], [11, [0.5, 0.5], 0], [12, [0.375, 0.5], 1], [None, [1.0] * 4, 0], [-50, [0.0] * 4, 1], [5, [], 1], [6, [], 2]]
    return [(*r, 1, 2, "x", 3) for r in rows]


def plain_mine(rows, positives=5, negatives=3, low=50, high=95):
    usable = []
    for own, (vec, v, label, *_) in enumerate(rows):
        if vec is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((own, vec, [math.floor(256 * x) for x in v], label))
    out = []
    for own, anchor, q, label in usable:
        if anchor % 50:
            continue
        near = sorted(((-sum(a * b for a, b in zip(q, v)), vec, other) for o, vec, v, other in usable if o != own and len(v) == len(q)), key=lambda x: x[:2])
        for s, positive, _ in [x for x in near if x[2] == label][:positives]:
            inside = [(n, vec) for n, vec, other in near if other != label and low * -s <= 100 * -n <= high * -s]
            out += [(anchor, positive, i + 1, vec, -s, -n) for i, (n, vec) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("options", [{}, {"positives": 1, "negatives": 1}, {"positives": 9, "negatives": 40, "low": 10, "high": 99}])
@pytest.mark.parametrize("bound", [1, hard_negatives.BLOCK_BYTES])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, options, bound):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", bound)
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 16)
    rows = vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = mined(hard_negatives.mine(table, F.col("vec_id") % 50 == 0, **options))
    assert got == plain_mine(rows, **options) and got


def test_hard_negatives_of_few_rows(spark):
    anchor = F.col("vec_id") % 50 == 0
    for rows in ([], vectors()[:1], [(0, [1.0], 1, 1, 1, "", 1), (1, [1.0], 1, 1, 1, "", 1)], [(0, None, 1, 1, 1, "", 1)]):
        assert mined(hard_negatives.mine(spark.createDataFrame(rows, VECTORS), anchor)) == []


def test_slots_are_disjoint_and_limits_exact(spark):
    scores = [0, 1, 2, 19, 20, 21, 101, 10**15 + 7, -1, -101, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(s,) for s in scores], "score long")
    rows = df.select("score", hard_negatives.share("score", 95).alias("h"), hard_negatives.share("score", 50, up=True).alias("l")).collect()
    for r in rows:
        assert r.h == r.score * 95 // 100 and r.l == -(-r.score * 50 // 100)


def test_searches_keep_rows_that_share_an_id(spark, tmp_path):
    """Both searches and their SQL twins count every row of a repeated id."""
    path = f"{tmp_path}/embeddings.parquet"
    rows = [r for r in vectors() if r[1] is None or len(r[1]) == 4]
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(path)
    for name in ("op4_exact_topk", "op11_hard_negatives"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(twin(name, embeddings=f"{path}/*.parquet"))
    found = topk.search(spark.read.parquet(path), F.col("vec_id") % 50 == 0)
    assert found.where("query_id = 50 and rank = 1").count() == 3


# --- packing ----------------------------------------------------------------------------


def check_packing(pieces, docs, capacity, most_padding):
    """``docs`` lists (doc_id, text); ids come from the tokenizers library."""
    from tokenizers import Tokenizer

    path, _ = json_vocabulary()
    library = Tokenizer.from_file(path)
    ids = lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1]
    want = defaultdict(int)
    for doc, text in docs:
        want[doc, tuple(ids(text))] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_doc[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    got = defaultdict(int)
    for (doc, tokens), own in by_doc.items():
        # Rows that share an id and a length are told apart by their pieces' places.
        copies = sum(p.start == 0 for p in own)
        spans = sorted(own, key=lambda p: (p.start, p.length, p.ids))
        if copies == 1:
            assert [p.start for p in spans] == list(np.cumsum([0] + [p.length for p in spans])[:-1])
            joined = np.frombuffer(b"".join(p.ids for p in spans), "<u4")
            assert len(joined) == tokens
            got[doc, tuple(joined.tolist())] += 1
        else:
            assert sum(p.length for p in spans) == copies * tokens
            texts_of = [k for k in want if k[0] == doc and len(k[1]) == tokens]
            assert sum(want[k] for k in texts_of) == copies
            for p in spans:
                assert any(np.array(k[1][p.start : p.start + p.length], "<u4").tobytes() == p.ids for k in texts_of)
            for k in texts_of:
                got[k] += want[k]
    assert got == want
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        size = sum(p.length for p in own)
        assert size <= capacity
        total += size
        padding += 0 if size & (size - 1) == 0 else capacity - size
    assert padding <= most_padding * total
    return total


def test_cuts():
    draw = random.Random(1)
    for capacity in (16, 100, 2048):
        for _ in range(500):
            n = draw.randint(0, 5 * capacity)
            for lengths in (packing.cut(n, capacity), packing.recut(n, capacity)):
                assert sum(lengths) == n and all(0 < x <= capacity for x in lengths)
            for x in packing.cut(n, capacity):
                slot = capacity // (capacity // x)
                assert slot - x <= packing.SLACK * slot


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_of_awkward_rows(spark, capacity):
    docs = frame(spark).repartition(4)
    special = spark.createDataFrame([(77, "a <|endoftext|> b <|endoftext|"), (None, "no id"), (78, " " * 5000)], "doc_id long, text string")
    docs = docs.unionByName(special, allowMissingColumns=True)
    pieces = packing.pack(docs, *json_vocabulary(), capacity=capacity).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(pieces, rows, capacity, 0.05)
    assert packing.pack(frame(spark, []), *json_vocabulary()).count() == 0
    only = packing.pack(frame(spark, [None]), *json_vocabulary()).collect()
    assert [(p.start, p.length, p.doc_tokens, p.offset) for p in only] == [(0, 1, 1, 0)]


def test_packing_of_documents(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    pieces = packing.pack(docs.repartition(3, "doc_id"), *json_vocabulary()).collect()
    check_packing(pieces, [tuple(r) for r in docs.collect()], 2048, 0.005)
    assert len(pieces) < 3 * docs.count()
    rows = QUERIES["op12_harmonic_packing"](spark, path).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows if r.start == 0) != []
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(json_vocabulary()[0])
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs.collect()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)


def test_both_tokenizer_libraries_agree():
    """Around every seventh code point and on long runs; all of them were compared once by hand."""
    from tokenizers import Tokenizer

    path, pattern = json_vocabulary()
    library, encoding = Tokenizer.from_file(path), packing.load_encoding(path, pattern)
    lines = [f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)} x\n{chr(c)}9" for c in range(1, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    lines += ["a" * 30_000, " " * 100_000 + "x", "\n \t" * 9_000, "ab" * 9_000, "!?" * 20_000, "<|endoftext|>" * 3]
    want = [e.ids for e in library.encode_batch_fast(lines, add_special_tokens=False)]
    assert all(encoding.encode_to_numpy(t, allowed_special="all").tolist() == w for t, w in zip(lines, want, strict=True))


# --- fill in the middle -----------------------------------------------------------------


def plain_fim(doc, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_of_awkward_rows(spark):
    extra = [
        "<P>", "x <S> y", "<M", "a<", "<<S", "S>P>M>", "<S", "ÀÉa1 b😀c", "İıſK", "a\x00b\r\n c", "<P" * 40, "word " * 40_000, "z" * 300_000, "漢字 kana かな",
    ]
    docs = frame(spark, texts() + extra * 8)
    docs = docs.unionByName(spark.createDataFrame([(None, "no id at all")], "doc_id long, text string"), allowMissingColumns=True)
    got = fim.transform(docs).withColumn("again", fim.restored("output", "form")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, repr(r))
    want = sorted((plain_fim(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert sorted((tuple(r)[:6] for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.again for r in got) == sorted(r.text or "" for r in docs.collect())
    assert fim.transform(frame(spark, [])).count() == 0


def test_ranks_equal_counts():
    draw = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = draw.integers(0, 8, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols, 3)
        places = np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, places).tolist() == np.cumsum(np.r_[0, symbols == s]).tolist()
