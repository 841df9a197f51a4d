"""Registered queries: cleaning, sampling and splitting of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharewise.functions import scores as sc
from sharewise.operators import clean
from sharewise.operators import sampling as sp
from sharewise.suite.common import (
    BASE_LANG, DOCS_SQL, LABELLED_SQL, NON_SPACE_SQL, R, ROW_KEY, ROW_KEY_SQL, SCORED_SQL, WORD_SQL,
    documents, hash_sql, labelled, query, r6, scored, table, unit_sql,
)

KEY = ["doc_id"]
LONG_ENOUGH = f"len(regexp_extract_all(text, '{NON_SPACE_SQL}')) >= 10"

# Documents as they come from several collections: the platform is known for some only, and
# a sentence ends in three blanks.
RAW_SQL = f"""{DOCS_SQL},
raw AS (SELECT doc_id, replace(text, '. ', '.   ') AS text, lang, CASE WHEN quality = 1 THEN 'web' END AS platform FROM docs)"""


def raw_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).join(labels, "doc_id", "left")
    return docs.select(
        "doc_id",
        F.replace("text", F.lit(". "), F.lit(".   ")).alias("text"),
        "lang",
        F.when(F.col("quality") == 1, "web").alias("platform"),
    )


@query("fill_null_text", f"WITH {RAW_SQL} SELECT doc_id, text, lang, coalesce(platform, ' ') AS platform FROM raw")
def fill_null_text(spark, sf_dir):
    return clean.fill_null_text(raw_documents(spark, sf_dir))


@query("filter_min_tokens", f"SELECT doc_id, n_chars FROM documents WHERE {LONG_ENOUGH}")
def filter_min_tokens(spark, sf_dir):
    return clean.filter_min_tokens(documents(spark, sf_dir)).select("doc_id", "n_chars")


@query("keep_word_tokens", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{WORD_SQL}'), ' ') AS text FROM documents")
def keep_word_tokens(spark, sf_dir):
    return clean.keep_word_tokens(documents(spark, sf_dir)).select("doc_id", "text")


@query("collapse_double_space", f"WITH {RAW_SQL} SELECT doc_id, replace(text, '  ', ' ') AS text FROM raw")
def collapse_double_space(spark, sf_dir):
    return clean.collapse_double_space(raw_documents(spark, sf_dir)).select("doc_id", "text")


@query("drop_columns", f"WITH {RAW_SQL} SELECT doc_id, text, lang FROM raw")
def drop_columns(spark, sf_dir):
    return clean.drop_columns(raw_documents(spark, sf_dir))


@query("clean_documents", f"WITH {RAW_SQL} SELECT doc_id, replace(text, '  ', ' ') AS text, lang FROM raw WHERE {LONG_ENOUGH}")
def clean_documents(spark, sf_dir):
    return clean.clean_documents(raw_documents(spark, sf_dir))


@query("contains_string", "SELECT doc_id, source FROM documents WHERE contains(text, 'que')")
def contains_string(spark, sf_dir):
    return clean.contains_string(documents(spark, sf_dir), "que").select("doc_id", "source")


@query(
    "split_words",
    f"""SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word
FROM (SELECT doc_id, regexp_extract_all(text, '{NON_SPACE_SQL}') AS w FROM documents) d""",
)
def split_words(spark, sf_dir):
    words = clean.split_words(documents(spark, sf_dir))
    return words.select("doc_id", F.posexplode("words").alias("pos", "word"))


@query(
    "language_flag",
    f"SELECT doc_id, lang, CASE WHEN lang = '{BASE_LANG}' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS language FROM documents",
)
def language_flag(spark, sf_dir):
    return clean.language_flag(documents(spark, sf_dir), base_lang=BASE_LANG).select("doc_id", "lang", "language")


@query("two_class_proba", f"WITH {SCORED_SQL} SELECT {ROW_KEY_SQL}, {R('1 - p')} AS p0, {R('p')} AS p1 FROM scored")
def two_class_proba(spark, sf_dir):
    pair = scored(spark, sf_dir).select(*ROW_KEY, sc.two_class_proba("p").alias("_pp"))
    return r6(pair.select(*ROW_KEY, F.col("_pp")[0].alias("p0"), F.col("_pp")[1].alias("p1")))


@query("logit", f"WITH {SCORED_SQL} SELECT {ROW_KEY_SQL}, {R('ln(p / (1 - p))')} AS z FROM scored")
def logit(spark, sf_dir):
    return r6(scored(spark, sf_dir).select(*ROW_KEY, sc.logit("p").alias("z")))


@query("count_records", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_records(spark, sf_dir):
    return clean.count_records(documents(spark, sf_dir), ["source"])


@query(
    "union_by_name",
    f"""SELECT doc_id, text, lang, CAST(NULL AS VARCHAR) AS source, n_chars FROM documents WHERE lang = '{BASE_LANG}'
UNION ALL SELECT doc_id, text, lang, source, NULL FROM documents WHERE lang <> '{BASE_LANG}'""",
)
def union_by_name(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own = docs.where(F.col("lang") == BASE_LANG).drop("source")
    other = docs.where(F.col("lang") != BASE_LANG).drop("n_chars")
    return clean.union_by_name([own, other])


@query(
    "assign_labels",
    """SELECT doc_id, CAST(1 AS DOUBLE) AS label FROM labels WHERE toxic = 1
UNION ALL SELECT doc_id, CAST(0 AS DOUBLE) FROM labels WHERE toxic = 0""",
)
def assign_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    both = [clean.assign_labels(labels.where(F.col("toxic") == t), t) for t in (1, 0)]
    return clean.union_by_name(both).select("doc_id", "label")


# --- samples and splits -----------------------------------------------------------------


def _ranked(source: str, seed: str, by: str = "", key: str = "doc_id", prefix: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    h = hash_sql(seed, f"{prefix}{key}")
    return f"(SELECT *, row_number() OVER ({part}ORDER BY {h}, {key}) AS r, count(*) {over} AS n FROM {source}) ranked"


@query("shuffle", f"SELECT doc_id, r - 1 AS position FROM {_ranked('documents', 'mix')}")
def shuffle(spark, sf_dir):
    return sp.shuffle_positions(documents(spark, sf_dir), KEY, "mix").select(
        "doc_id", F.col("position").cast("long").alias("position")
    )


@query("sampled_scan", f"SELECT doc_id, text, lang, source, n_chars FROM {_ranked('documents', 'scan')} WHERE r <= 150")
def sampled_scan(spark, sf_dir):
    return sp.sampled_scan(documents(spark, sf_dir), KEY, 150, "scan")


@query(
    "sample_n_without_replacement",
    f"SELECT doc_id, source FROM {_ranked('documents', 'draw', 'source')} WHERE r <= 2",
)
def sample_n_without_replacement(spark, sf_dir):
    return sp.sample_n(documents(spark, sf_dir), KEY, 2, "draw", ["source"]).select("doc_id", "source")


@query(
    "head_tail_split",
    f"SELECT doc_id, CASE WHEN r <= floor(n * 0.5) THEN 'head' ELSE 'tail' END AS part FROM {_ranked('documents', 'halves')}",
)
def head_tail_split(spark, sf_dir):
    return sp.head_tail_split(documents(spark, sf_dir), KEY, 0.5, "halves").select("doc_id", "part")


def _pos_neg(spark, sf_dir):
    """Toxic documents, and the clean ones as the larger pool to sample from."""
    docs = labelled(spark, sf_dir)
    return docs.where("label = 1"), docs.where("label = 0")


def _mix_sql(seed: str, size: str) -> str:
    return f"""WITH {LABELLED_SQL}, neg AS (SELECT * FROM labelled WHERE label = 0)
SELECT doc_id, text, lang, label FROM labelled WHERE label = 1
UNION ALL SELECT doc_id, text, lang, label FROM {_ranked('neg', seed)} WHERE r <= {size}"""


@query("ratio_mix", _mix_sql("ratio", "7 * (SELECT count(*) FROM labelled WHERE label = 1) // 3"))
def ratio_mix(spark, sf_dir):
    pos, neg = _pos_neg(spark, sf_dir)
    return sp.ratio_mix(pos, neg, KEY, (7, 3), "ratio")


@query("balanced_mix", _mix_sql("even", "(SELECT count(*) FROM labelled WHERE label = 1)"))
def balanced_mix(spark, sf_dir):
    pos, neg = _pos_neg(spark, sf_dir)
    return sp.balanced_mix(pos, neg, KEY, "even")


@query("fraction_mix", _mix_sql("tenth", "floor(n * 0.1)"))
def fraction_mix(spark, sf_dir):
    pos, neg = _pos_neg(spark, sf_dir)
    return sp.fraction_mix(pos, neg, KEY, 0.1, "tenth")


_COPIES = 3


@query(
    "bootstrap_resample",
    f"""WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels WHERE toxic = 1),
size AS (SELECT count(*) AS n FROM numbered),
draws AS (SELECT CAST(rep AS INTEGER) AS replicate_id, CAST(floor({unit_sql('boot', "rep || '|' || j")} * n) AS BIGINT) AS i
          FROM size, range(0, {_COPIES}) a(rep), (SELECT unnest(range(0, (SELECT n FROM size))) AS j) b)
SELECT replicate_id, doc_id, count(*) AS copies FROM draws JOIN numbered USING (i) GROUP BY 1, 2""",
)
def bootstrap_resample(spark, sf_dir):
    pos = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return sp.bootstrap_resample(pos, KEY, _COPIES, "boot")


@query(
    "stratified_test_sample",
    f"WITH {LABELLED_SQL} SELECT doc_id, label FROM {_ranked('labelled', 'strata', 'label')} WHERE r <= floor(n * 0.1)",
)
def stratified_test_sample(spark, sf_dir):
    return sp.stratified_sample(labelled(spark, sf_dir), KEY, "label", 0.1, "strata").select("doc_id", "label")


@query(
    "train_val_split",
    f"""WITH {LABELLED_SQL}, each AS (SELECT doc_id, label, CAST(m AS INTEGER) AS member_id FROM labelled, range(0, 3) r(m))
SELECT member_id, doc_id, CASE WHEN r <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'train' END AS part
FROM {_ranked('each', 'members', 'member_id', prefix="member_id || '|' || ")}""",
)
def train_val_split(spark, sf_dir):
    each = labelled(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.lit(m) for m in range(3)])).alias("member_id"))
    return sp.train_val_split(each, KEY, 0.2, "members", ["member_id"]).select("member_id", "doc_id", "part")


@query(
    "strat_split",
    f"""WITH {LABELLED_SQL}
SELECT doc_id, label, CASE WHEN r <= floor(n * CASE WHEN label = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END) THEN 'test' ELSE 'train' END AS part
FROM {_ranked('labelled', 'split', 'label')}""",
)
def strat_split(spark, sf_dir):
    return sp.strat_split(labelled(spark, sf_dir), KEY, "label", {0.0: 0.2, 1.0: 0.5}, "split").select("doc_id", "label", "part")


@query(
    "kfold_assign",
    f"WITH {LABELLED_SQL} SELECT doc_id, label, CAST((r - 1) % 10 AS INTEGER) AS fold FROM {_ranked('labelled', 'folds', 'label')}",
)
def kfold_assign(spark, sf_dir):
    return sp.kfold_assign(labelled(spark, sf_dir), KEY, "label", 10, "folds")
