"""Small inputs that hold every awkward case at once."""

import random

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, id string, key string,"
    " block long, batch string, count string, label string, fp long, taken long, _rows int"
)


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join(draw.choice(["alpha", "beta", "Gamma", "delta,", "épée", "zeta.", "漢字", "eta"]) + str(draw.randint(0, 99)) for _ in range(words))


def texts():
    long = prose(1, 20_000)
    passage = prose(2, 90)
    return [
        None, "", " \t\n", "one", "one two", "ONE two", "a" * 3000, long, long, prose(3, 120), prose(3, 119) + " changed",
        prose(4, 60) + " " + passage + " " + prose(5, 60), passage + prose(6, 50), "x" + passage, "😀 " * 40, "é" * 500 + "è" * 500,
        prose(7, 300), prose(7, 300), "released under the MIT license.", "Apache-License, version 2.0; CC BY-NC",
    ]


def frame(spark, rows=None):
    """Rows of texts with null sources, repeated rows, and columns whose names clash."""
    rows = texts() if rows is None else rows
    out = [(i, t, "en", [None, "b", "a", "é"][i % 4], None if t is None else len(t), *[7, "x", "k", 3, "y", "z", "w", 5, 6, 4]) for i, t in enumerate(rows)]
    if len(rows) > 3:
        out += [out[3], out[-1]]
    return spark.createDataFrame(out, DOCS).repartition(3)
