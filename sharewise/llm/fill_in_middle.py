"""Fill-in-the-middle texts: two cuts between units, found on a wavelet matrix of character classes.

A unit is a run of ASCII letters or any other code point.  Every UTF-8 byte has one of four classes:
a code point that is no letter, a letter that begins a run, a letter that goes on, or a byte
that goes on a code point.  A wavelet matrix over the classes of a whole batch of texts answers how many bytes of a
class stand before a place, by two popcounts.  Units before a place are the ranks of the
first two classes together, code points those of the first three; a cut after u units is found by
bisection on that count, for all texts of the batch at once.  No unit is an object.

Output: plain, the text; psm, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; spm, ``<S>`` suffix ``<P>``
prefix ``<M>`` middle.  The draws of a row come from a digest of its doc_id, so reruns agree.

Defined cases: a null text counts as empty; empty texts and texts that hold a marker are plain; a null doc_id
draws as an empty string; repeated rows have the same output each; very long texts are one piece
of work by themselves; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm import texts

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Character classes.
OTHER, HEAD, BODY, INNER = range(4)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Bits:
    """A bit vector that counts the ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols of ``depth`` bits; each level holds one bit of all symbols, ordered by the bits above it."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(depth)):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How many of the first ``place`` symbols are ``symbol``."""
        start, end = np.zeros_like(place), place
        for shift, bits, zeros in self.levels:
            if symbol >> shift & 1:
                start, end = zeros + bits.ones(start), zeros + bits.ones(end)
            else:
                start, end = start - bits.ones(start), end - bits.ones(end)
        return end - start


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte; a run of letters ends with its text."""
    letter = _LETTER[data]
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[offsets[:-1][offsets[:-1] < len(data)]] = False
    out = np.where(letter, np.where(goes_on, BODY, HEAD), OTHER).astype(np.uint8)
    out[data & 0xC0 == 0x80] = INNER
    return out


class Boundaries:
    """Units and code points of the texts of a batch, counted by ranks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.matrix = WaveletMatrix(classes(data, offsets), 2)
        self.start, self.end = offsets[:-1], offsets[1:]
        self.n = self.units(self.end) - self.units(self.start)

    def units(self, place: np.ndarray) -> np.ndarray:
        """Units that begin before each place of the batch."""
        return self.matrix.rank(OTHER, place) + self.matrix.rank(HEAD, place)

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between two places."""
        return end - start - self.matrix.rank(INNER, end) + self.matrix.rank(INNER, start)

    def after(self, count: np.ndarray) -> np.ndarray:
        """The place in each text after its first ``count`` units: where the next begins, or the end."""
        wanted = self.units(self.start) + count
        low, high = self.start.copy(), self.end.copy()
        while (open_ := low < high).any():
            middle = low + high >> 1
            begun = self.units(np.minimum(middle + 1, self.end)) > wanted
            high = np.where(open_ & begun, middle, high)
            low = np.where(open_ & ~begun, middle + 1, low)
        return low


def draws(seed: int) -> Column:
    """Four unsigned 32-bit integers from the SHA-256 of seed, colon and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column("draws").flatten().to_numpy().reshape(-1, 4)
            for first, data, offsets in texts.pieces(*texts.flat(batch.column("text"))):
                size = len(offsets) - 1
                h = drawn[first : first + size]
                units = Boundaries(data, offsets)
                ends = np.sort(h[:, :2] % (units.n + 1)[:, None], axis=1)
                one, two = units.after(ends[:, 0]), units.after(ends[:, 1])
                before, inside = units.chars(units.start, one), units.chars(one, two)
                plain, spm = h[:, 2] % 100 >= 100 - plain_percent, h[:, 3] % 100 < spm_percent
                out, forms = [], []
                body = data.tobytes()
                for start, a, b, end, p, s in zip(*(x.tolist() for x in (units.start, one, two, units.end, plain, spm)), strict=True):
                    text = body[start:end]
                    if p or not text or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        forms.append("plain")
                        out.append(text)
                        continue
                    prefix, middle, suffix = body[start:a], body[a:b], body[b:end]
                    forms.append("spm" if s else "psm")
                    first_two = (SUFFIX, suffix, PREFIX, prefix) if s else (PREFIX, prefix, SUFFIX, suffix)
                    out.append(b"".join((*first_two, MIDDLE, middle)))
                whole = np.array([f == "plain" for f in forms], bool)
                columns = [
                    batch.column("doc_id").slice(first, size), pa.array(units.n, pa.int64()), pa.array(forms, pa.string()),
                    pa.array(before, pa.int64(), mask=whole), pa.array(inside, pa.int64(), mask=whole),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, list(names))

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text", draws(seed).alias("draws")).mapInArrow(work, schema)


def restored(output: str, form: str) -> Column:
    """The text an output was made from."""
    parts = F.split(F.substring(output, 4, 2**31 - 1), f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}")
    psm, spm = F.concat(parts[0], parts[2], parts[1]), F.concat(parts[1], parts[2], parts[0])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)
