"""Scientific term analyzer.

The grammar needs Unicode normalisation, which Spark SQL does not offer, so texts cross to
Python in Arrow batches. No token and no normalisation reaches over ASCII white space, so the texts
of a slice are cut there, each distinct piece is expanded to terms once, and the terms of all its
rows are counted together.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ANALYZER_VERSION = "scientific-nfkc-latin-cjk-v1"

# English function words that are not indexed.
STOP_WORDS = (
    "a an and are as at be been being by can could did do does for from had has have how if in "
    "into is it its of on or that the their these this those to was were what when where which "
    "who why will with would"
).split()

# Element symbols by atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se "
    "Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb "
    "Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm "
    "Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

# Token grammar, dash characters folded to "-".
TOKEN = (
    "[A-Za-z][A-Za-z0-9]*(?:[-+][A-Za-z0-9]+)*[+-]?"
    "|[+-]?\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?"
    "|[\u0370-\u03ff]+|[\u3400-\u9fff]+"
)
DASHES = "−–—‐‑"

SLICE_BYTES = 2 << 20  # text that is analyzed at once, besides a single longer text

# A formula is a run of known symbols with counts; symbols are delimited by their capitals, so
# an alternation over the table decides membership without splitting the word.
FORMULA = f"^(?:(?:{'|'.join(ELEMENTS)})[0-9]*)+[+-]?$"

# Characters that normalisation never changes, alone or in sequence.
_STABLE = (
    "\\x00-\\x7f\\x{a1}-\\x{a7}\\x{a9}\\x{ab}-\\x{ae}\\x{b0}\\x{b1}\\x{b6}\\x{b7}\\x{bb}"
    "\\x{bf}-\\x{131}\\x{134}-\\x{13e}\\x{141}-\\x{148}\\x{14a}-\\x{17e}\\x{4e00}-\\x{9fff}"
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """NFKC; stable rows pass null to the Python side and keep their text."""
    ascii_only = F.octet_length(text) == F.length(text)  # far cheaper than the pattern
    return F.coalesce(_nfkc(F.when(~ascii_only & text.rlike(f"[^{_STABLE}]"), text)), text)


class _Terms(dict):
    """word -> its terms, worked out on first sight."""

    def __init__(self):
        super().__init__()
        self.is_formula = re.compile(FORMULA).match
        self.stop = frozenset(STOP_WORDS)

    def __missing__(self, word: str) -> tuple[str, ...]:
        head = word[0]
        if head >= "\u3400":
            grams = (*word, *map("".join, zip(word, word[1:])))
            terms = tuple(f"c:{gram}" for gram in grams)
        elif head in "+-" or head.isdecimal():
            terms = (f"n:{word.casefold()}",)
        else:
            folded = word.casefold()
            parts = [folded, *(folded.split("-") if "-" in folded else [])]
            terms = tuple(f"w:{part}" for part in parts if part and part not in self.stop)
            if head <= "Z" and self.is_formula(word):
                terms = (f"chem:{word}", *terms)
        self[word] = terms
        return terms


class Analyzer:
    """Holds the compiled grammar and the word cache of one task."""

    CACHE_WORDS = 500_000
    CACHE_LENGTH = 64  # longer pieces of text, as of scripts without spaces, hardly come again

    def __init__(self):
        self.words = re.compile(TOKEN).findall
        self.dashes = str.maketrans(dict.fromkeys(DASHES, "-"))
        self.terms = _Terms()
        self.vocabulary: list[str] = []  # terms by number, as ``tally`` counts them
        self._numbers: dict[str, int] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def _words(self, text: str) -> list[str]:
        if len(self.terms) > self.CACHE_WORDS:
            self.terms.clear()
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
            if any(map(text.__contains__, DASHES)):
                text = text.translate(self.dashes)
        return self.words(text)

    def sequence(self, text: str) -> list[str]:
        return [term for word in self._words(text) for term in self.terms[word]]

    def counts(self, text: str) -> dict[str, int]:
        total: dict[str, int] = {}
        seen, terms = total.get, self.terms
        for word, n in Counter(self._words(text)).items():
            for term in terms[word]:
                total[term] = seen(term, 0) + n
        return total

    def _number(self, piece: str) -> tuple[int, ...]:
        """Numbers of the terms of a piece of text, new ones given in the order of their coming."""
        core = piece.rstrip(".,;:!?)\"'")  # characters that never belong to a word before them
        number, vocabulary = self._numbers.get, self.vocabulary
        if core.isascii() and core.isalnum() and core[0] >= "A":
            if core[0] >= "a":  # no formula
                folded = core.lower()
                terms = () if folded in self.terms.stop else ("w:" + folded,)
            else:
                terms = self.terms[core]
        else:
            terms = self.sequence(piece)
        found = []
        for term in terms:
            n = number(term)
            if n is None:
                n = self._numbers[term] = len(vocabulary)
                vocabulary.append(term)
            found.append(n)
        found = tuple(found)  # of numbers alone, which the collector soon leaves out
        if len(piece) <= self.CACHE_LENGTH:
            self._pieces[piece] = found
        return found

    def tally(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, count) of every distinct term of every text, row by row, in order of first occurrence.

        Numbers are places in ``vocabulary`` and hold until the next call; null counts as empty.
        """
        if len(self._pieces) + len(self.vocabulary) > self.CACHE_WORDS:
            self._pieces.clear(), self._numbers.clear(), self.vocabulary.clear(), self.terms.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        known = self._pieces.get
        numbers = [self._number(p) if (n := known(p)) is None else n for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        code = coded.indices.to_numpy(zero_copy_only=False)
        repeats = sizes[code]
        ends = np.cumsum(repeats)
        place = np.repeat((np.cumsum(sizes) - sizes)[code] - ends + repeats, repeats) + np.arange(ends[-1] if len(ends) else 0)
        term = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))[place]
        row = np.repeat(np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False)), repeats)
        many = max(1, len(self.vocabulary))
        which, keys = pd.factorize(row * many + term)
        return keys // many, keys % many, np.bincount(which, minlength=len(keys))


_kept: list[Analyzer] = []


def kept_analyzer() -> Analyzer:
    """The analyzer of this process, whose words its later tasks know already."""
    if not _kept:
        _kept.append(Analyzer())
    return _kept[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that no slice holds much more than ``limit`` bytes of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit, prepend=-1))
        for start, stop in zip(edges, [*edges[1:], batch.num_rows]):
            yield batch.slice(int(start), int(stop - start))


def term_columns(analyzer: Analyzer, batch: pa.RecordBatch, vocabulary: pa.Array | None = None) -> tuple[list[pa.Array], tuple]:
    """Columns row_id, length, terms and, with a ``vocabulary``, matched of ``batch`` (row_id, text), and its tally."""
    row, term, count = analyzer.tally(batch.column("text"))
    local, used = pd.factorize(term)
    distinct = pa.array([analyzer.vocabulary[i] for i in used], pa.string())
    nested = lambda first, of, n, name: pa.ListArray.from_arrays(
        pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32()),
        pa.StructArray.from_arrays([first, pa.array(n, pa.int32())], [name, "tf"]))
    totals = np.bincount(row, count, batch.num_rows).astype(np.int64)
    columns = [batch.column("row_id"), pa.array(totals), nested(distinct.take(pa.array(local)), row, count, "term")]
    if vocabulary is not None:
        code = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)[local]
        hit = code >= 0
        columns.append(nested(pa.array(code[hit], pa.int32()), row[hit], count[hit], "code"))
    return columns, (row, term, count)


def analyze_rows(texts: DataFrame) -> DataFrame:
    """(row_id, text) -> (row_id, length, terms array<struct<term,tf>>); empty rows keep length 0."""
    key = dict(texts.dtypes)["row_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer = kept_analyzer()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(term_columns(analyzer, batch)[0], ["row_id", "length", "terms"])

    return texts.select("row_id", "text").mapInArrow(
        run, f"row_id {key}, length bigint, terms array<struct<term:string,tf:int>>")


def fingerprint() -> str:
    """Digest of everything that decides the analyzer's output."""
    profile = {
        "version": ANALYZER_VERSION,
        "unicode": unicodedata.unidata_version,
        "token": TOKEN,
        "stop_words": sorted(STOP_WORDS),
        "elements": sorted(ELEMENTS),
        "cjk": "unigrams_and_bigrams",
    }
    return hashlib.sha256(json.dumps(profile, sort_keys=True).encode()).hexdigest()
