"""Fuzzy search for short license notices: exact seeds, then bounded-error matching.

Texts are lower-cased (A-Z) and reduced to words joined by one blank.  A notice that may hold e
edits is cut into e + 1 pieces; by the pigeonhole principle one of them stands unchanged in every
place with at most e edits, so only windows around exact pieces are candidates.  Spark keeps
the texts with a seed; in them every run of whole words about a seed is matched by the regex library
with at most e errors, which verifies the edits.  Of places of a notice that overlap, the one with
fewest edits stands, then the first.  A place without edits is a *base* place.  The words that tell one license from another must stand unedited.

Defined cases: null and empty texts have no words, places or labels and score 0; repeated rows are
scanned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    #: Words that an edited place must hold as they are.
    telling: tuple[str, ...]
    #: A base notice counts in n_base and base_labels.
    base: bool = False

    @property
    def edits(self) -> int:
        """One edit for each ten characters; very short notices are matched exactly."""
        return len(self.phrase) // 10

    def seeds(self) -> list[tuple[int, str]]:
        """(offset, piece): e + 1 pieces that cover the phrase."""
        n = self.edits + 1
        cuts = [len(self.phrase) * i // n for i in range(n + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


# The notices and their labels.
NOTICES = (
    Notice("under the mit license", "mit", ("mit",), base=True),
    Notice("apache license version 2", "apache-2", ("2",), base=True),
    Notice("cc by nc", "cc-by-nc", ("cc", "by", "nc"), base=True),
    Notice("gnu general public license version 2", "gpl-2", ("general", "2")),
    Notice("gnu general public license version 3", "gpl-3", ("general", "3")),
    Notice("gnu lesser general public license", "lgpl", ("lesser",)),
    Notice("mozilla public license version 2", "mpl-2", ("mozilla", "2")),
    Notice("bsd 3 clause license", "bsd-3-clause", ("bsd", "3")),
    Notice("bsd 2 clause license", "bsd-2-clause", ("bsd", "2")),
)

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal(text: F.Column) -> F.Column:
    """The words of a text, joined by one blank."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.btrim(F.regexp_replace(lowered, _BREAKS, " "), F.lit(" "))


def places(text: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of every place of every notice in a normal text."""
    import regex

    out = []
    for number, notice in enumerate(notices):
        size, edits = len(notice.phrase), notice.edits
        whole = rf"(?<![^ ]){re.escape(notice.phrase)}(?![^ ])"
        exact = {m.start() for m in re.finditer(whole, text)}
        out += [(number, s, s + size, 0) for s in exact]
        if not edits:
            continue
        # A place with at most ``edits`` edits starts and ends within that many characters of a seed's shift.
        shifts = {
            m.start() - offset
            for offset, piece in notice.seeds()
            for m in re.finditer(f"(?={re.escape(piece)})", text)
        }
        starts = {at for s in shifts for at in range(max(0, s - edits), min(len(text), s + edits + 1)) if at == 0 or text[at - 1] == " "}
        fuzzy = regex.compile(rf"(?b)(?:{regex.escape(notice.phrase)}){{1<=e<={edits}}}")
        found = []
        for start in starts:
            for end in range(start + size - edits, min(len(text), start + size + edits) + 1):
                if end < len(text) and text[end] != " ":
                    continue
                if any(s < end and start < s + size for s in exact):
                    continue
                own = text[start:end].split(" ")
                if all(word in own for word in notice.telling) and (match := fuzzy.fullmatch(text, start, end)):
                    found.append((sum(match.fuzzy_counts), start, end))
        # Of places that overlap the one with fewest edits stands, then the first.
        taken: list[tuple[int, int]] = []
        for cost, start, end in sorted(found):
            if not any(a < end and start < b for a, b in taken):
                taken.append((start, end))
                out.append((number, start, end, cost))
    return sorted(out, key=lambda p: (p[1], p[0]))


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per row: doc_id, n_words and spans (label, base, first word, words, edits, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seeds = sorted({piece for n in notices for _, piece in n.seeds()})
    words = docs.select("doc_id", normal(F.col("text")).alias("_words"))
    blanks = F.length("_words") - F.length(F.replace("_words", F.lit(" "), F.lit("")))
    words = words.select(
        "doc_id",
        F.when(F.col("_words") == "", F.lit(0)).otherwise(blanks + 1).cast("long").alias("n_words"),
        F.when(F.col("_words").rlike("|".join(re.escape(s) for s in seeds)), F.col("_words")).alias("_candidate"),
    )
    spans = pa.list_(pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int64()),
        ("edits", pa.int64()), ("likeness", pa.float64()), ("text", pa.string()),
    ]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("_candidate").to_pylist():
                found = places(text, notices) if text is not None else []
                rows.append([
                    {
                        "label": notices[n].label,
                        "base": notices[n].base and edits == 0,
                        "first_word": text.count(" ", 0, start),
                        "words": text.count(" ", start, end) + 1,
                        "edits": edits,
                        "likeness": 1 - edits / len(notices[n].phrase),
                        "text": text[start:end],
                    }
                    for n, start, end, edits in found
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(rows, spans)],
                ["doc_id", "n_words", "spans"],
            )

    return words.mapInArrow(
        work,
        f"doc_id {kind}, n_words long, spans array<struct<label: string, base: boolean, first_word: long,"
        " words: long, edits: long, likeness: double, text: string>>",
    )
