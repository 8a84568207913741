"""Fill-in-middle transformation: cuts located on a wavelet matrix over
character classes.

A text is cut into units: a run of letters A-Z, a-z is one unit, any other code
point is one by itself. Every code point falls into one of four classes (other,
white space, first letter of a run, later letter of a run), and a wavelet matrix
of two levels holds the classes of a step of texts in a row. Rank queries give
how often each class occurs before a place; the ranks of the classes that begin
a unit add up to the number of units begun there. A cut after u units is the
last place with at most u units begun before it, which bisection finds for all
texts of the step at once. No unit is ever listed.

Prefix, middle and suffix are then joined with marks: ``psm`` writes
``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` writes suffix and prefix the
other way round, ``plain`` is the text as it was. Which, and where the cuts lie,
follows from the SHA-256 of ``1:`` and the doc_id alone, so reruns agree.
``restored`` rebuilds the text from output and form.

Null texts are empty texts; these, and texts that hold a mark, stay plain. A
null doc_id counts as an empty string in the hash. Repeated rows each get a
row, with equal results. Texts of any length are cut whole: a task works on
``STEP_BYTES`` of texts at a time, or on one text if that is longer. An empty
table gives no rows. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, pick, plain_strings, ship_package, string_bytes

#: The marks, and the shares of plain and of spm texts.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20

OTHER, SPACE, FIRST, LATER = range(4)
#: A unit begins at each code point of these classes.
BEGINS = (OTHER, SPACE, FIRST)

#: Bytes of text that are cut at a time.
STEP_BYTES = 4 << 20

_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


class BitRanks:
    """Bits in words of 64 with the number of set bits before each word."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])

    def ones(self, place: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, rest = place >> 6, (place & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Ranks over a sequence of symbols below ``2 ** bits``: one bit vector a
    level, most significant bit first; each next level holds the symbols stably
    parted by the bits of this one."""

    def __init__(self, symbols: np.ndarray, bits: int = 2):
        self.bits = bits
        self.levels: list[tuple[BitRanks, int]] = []
        for level in reversed(range(bits)):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((BitRanks(bit), len(bit) - int(np.count_nonzero(bit))))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each place."""
        first = np.zeros(1, np.int64)
        for depth, (ranks, zeros) in enumerate(self.levels):
            ones, ones_first = ranks.ones(place), ranks.ones(first)
            if symbol >> (self.bits - 1 - depth) & 1:
                place, first = zeros + ones, zeros + ones_first
            else:
                place, first = place - ones, first - ones_first
        return place - first


def _letters_and_spaces() -> tuple[np.ndarray, np.ndarray]:
    letter, space = np.zeros(256, bool), np.zeros(256, bool)
    for a in b"aA":
        letter[a : a + 26] = True
    space[[0x20, *range(0x09, 0x0E)]] = True
    return letter, space


_LETTER, _SPACE = _letters_and_spaces()


class Units:
    """The units of several texts, laid end to end as UTF-8."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        """``starts``: where each text begins in ``raw``, and the end."""
        #: Byte of each code point, and the end.
        self.at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        lead = raw[self.at[:-1]]
        #: First code point of each text, and the end.
        self.first = np.searchsorted(self.at, starts)
        letter = _LETTER[lead]
        later = letter.copy()
        later[1:] &= letter[:-1]
        later[:1] = False
        later[self.first[:-1][self.first[:-1] < len(lead)]] = False
        symbols = np.where(letter, np.where(later, LATER, FIRST), np.where(_SPACE[lead], SPACE, OTHER)).astype(np.uint8)
        self.matrix = WaveletMatrix(symbols)

    def begun(self, place: np.ndarray) -> np.ndarray:
        """Units that begin before each place, over all texts in a row."""
        return sum(self.matrix.rank(c, place) for c in BEGINS)

    def counts(self) -> np.ndarray:
        return np.diff(self.begun(self.first))

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """The place after the first ``units[i]`` units of each text i."""
        low, high = self.first[:-1].copy(), self.first[1:].copy()
        most = self.begun(low) + units
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.begun(middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def hashes(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 32-bit groups of the SHA-256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform_texts(texts: pa.Array, hashed: list[np.ndarray]) -> pa.StructArray:
    """Per text: n, form, prefix_chars, middle_chars, output."""
    texts = plain_strings(texts)
    raw, starts = string_bytes(texts)
    units = Units(raw, starts)
    n = units.counts()
    drawn = np.stack([hashed[0] % (n + 1), hashed[1] % (n + 1)])
    cut = [units.first[:-1], *(units.cuts(u) for u in (drawn.min(axis=0), drawn.max(axis=0))), units.first[1:]]
    sizes = np.diff(np.stack(cut), axis=0)
    at = units.at[np.stack(cut)]
    whole = raw.tobytes()
    form, output = [], []
    for i in range(len(texts)):
        text = whole[at[0, i] : at[3, i]]
        if not text or hashed[2][i] % 100 >= PLAIN_FROM or any(m.encode() in text for m in MARKS):
            form.append("plain")
            output.append(text)
            continue
        prefix, middle, suffix = (whole[at[k, i] : at[k + 1, i]] for k in range(3))
        p, s, m = (mark.encode() for mark in MARKS)
        spm = hashed[3][i] % 100 < SPM_BELOW
        form.append("spm" if spm else "psm")
        output.append(b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]))
    plain = np.array([f == "plain" for f in form], bool)
    return pa.StructArray.from_arrays(
        [
            pa.array(n),
            pa.array(form, pa.string()),
            pa.array(sizes[0], mask=plain),
            pa.array(sizes[1], mask=plain),
            pa.array(output, pa.binary()).cast(pa.string()),
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _transformed():
    @F.arrow_udf(_RESULT)
    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        hashed = [np.asarray(h, np.int64) for h in (h1, h2, h3, h4)]
        texts = plain_strings(texts)
        parts = [transform_texts(texts.slice(a, b - a), [h[a:b] for h in hashed]) for a, b in byte_slices(texts, STEP_BYTES)]
        return pa.concat_arrays(parts) if parts else transform_texts(texts, hashed)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per document: doc_id, n (units), form, prefix_chars, middle_chars (null
    if plain), output."""
    ship_package(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    out = rows.select("doc_id", _transformed()("text", *hashes(F.col("doc_id"), seed)).alias("t"))
    return out.select("doc_id", "t.n", "t.form", "t.prefix_chars", "t.middle_chars", "t.output")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given (null: empty)."""
    parts = F.split(output, "|".join(MARKS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
