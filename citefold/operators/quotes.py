"""Exact quotations located in a corpus without comparing every quote with every text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.functions.runs import word_runs
from citefold.functions.text import unique_alignment, words
from citefold.operators.scale import BROADCAST_LIMIT, measured_bytes, measured_join
from citefold.session import stage

SEED_WORDS = 4


def find_quotes(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, text_id, status, char_start, char_end) of every verbatim occurrence.

    ``texts``: text_id, text; ``quotes``: quote_id, quote. The inner words of a contained quote are
    whole words of the text, so a run of inner words is an exact join key; candidates are then
    verified on the raw text. Quotes too short to have inner words are scanned for directly.
    """
    split = stage(quotes.select("quote_id", "quote", words(F.col("quote")).alias("w")), "quotes")
    seeded = split.filter(F.size("w") >= 3)
    inner = F.slice(F.col("w"), F.lit(2), F.least(F.lit(SEED_WORDS), F.size("w") - 2))
    inner = seeded.select("quote_id", F.size(inner).alias("n"), F.array_join(inner, " ").alias("text"))
    sizes = sorted(r["n"] for r in inner.select("n").distinct().collect())  # at most SEED_WORDS values
    candidates = []
    if sizes:
        seeds = stage(reduce(DataFrame.unionByName, [  # the inner words are one run of their number
            word_runs(inner.filter(F.col("n") == n).select("quote_id", "text"), [n]) for n in sizes]), "quote-seeds")
        few = measured_bytes(seeds) <= BROADCAST_LIMIT
        only = seeds.select("h").distinct().toArrow().column("h").to_numpy() if few else None
        shingled = word_runs(texts.select("text_id", "text"), sizes, only)
        candidates.append(measured_join(shingled, seeds, ["h"]).select("quote_id", "text_id"))
    short = split.filter((F.size("w") < 3) & (F.col("quote") != "")).select("quote_id", "quote")
    if not short.isEmpty():
        candidates.append(_scan(texts, short))
    if not candidates:
        none = F.lit(None).cast(dict(texts.dtypes)["text_id"])
        candidates.append(split.limit(0).select("quote_id", none.alias("text_id")))
    pairs = candidates[0] if len(candidates) == 1 else candidates[0].unionByName(candidates[1])
    pairs = stage(pairs, "quote-candidates")
    met = measured_join(texts, pairs, ["text_id"])
    return (measured_join(met, split.select("quote_id", "quote"), ["quote_id"])
            .withColumn("found", unique_alignment(F.col("text"), F.col("quote")))
            .filter(F.col("found.status").isin("exact_unique", "ambiguous"))
            .select("quote_id", "text_id", "found.*"))


def _scan(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Direct search for the few quotes of one or two words: one pass of an automaton over each text."""
    found = align_quotes(texts, short, normalized=False)
    return found.filter("text_id is not null").select("quote_id", "text_id")


# ---- all statuses by an automaton ---------------------------------------------------------------

AUTOMATON_BYTES = 16 << 20  # quotes that one automaton holds; more take further passes over the texts


def squeeze(text: str) -> str:
    """Compatibility form without white space."""
    return "".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


def squeezed_offsets(text: str) -> tuple[str, list[int]] | None:
    """(squeezed text, raw position of each of its characters); null where characters join across a starter.

    The text is normalised in pieces, each a starter with the marks that follow it.
    """
    out, at, begin = [], [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not unicodedata.combining(text[i]):
            piece = squeeze(text[begin:i])
            out.append(piece)
            at += [begin] * len(piece)
            begin = i
    joined = "".join(out)
    return (joined, at) if joined == squeeze(text) else None


class QuoteAutomaton:
    """Aho-Corasick automata over raw and squeezed quotes: one run over a text finds all quotes in it."""

    def __init__(self, quotes: list[tuple], normalized: bool):
        self.raw, self.plain = self._build((q, i) for i, q in quotes), None
        if normalized:
            self.plain = self._build((squeeze(q), i) for i, q in quotes)

    @staticmethod
    def _build(items):
        groups: dict[str, list] = {}
        for quote, number in items:
            if quote:
                groups.setdefault(quote, []).append(number)
        if not groups:
            return None
        automaton = ahocorasick.Automaton()
        for quote, numbers in groups.items():
            automaton.add_word(quote, (len(quote), numbers))
        automaton.make_automaton()
        return automaton

    @staticmethod
    def _places(automaton, text: str) -> dict:
        """number -> (start, end, whether it occurs again)."""
        found: dict = {}
        for end, (size, numbers) in automaton.iter(text) if automaton else ():
            for number in numbers:
                old = found.get(number)
                found[number] = (end + 1 - size, end + 1, False) if old is None else (*old[:2], True)
        return found

    def align(self, text: str) -> list[tuple]:
        """(number, status, char_start, char_end, near_start, near_end) of every quote that the text holds."""
        exact = self._places(self.raw, text)
        out = [(n, "ambiguous", None, None, None, None) if again else (n, "exact_unique", a, b, a, b) for n, (a, b, again) in exact.items()]
        if self.plain is None:
            return out
        plain = squeeze(text)
        near = {n: v for n, v in self._places(self.plain, plain).items() if n not in exact}
        if near:
            mapped = squeezed_offsets(text)
            for n, (a, b, again) in near.items():
                span = (None, None) if again or mapped is None else (mapped[1][a], mapped[1][b - 1] + 1)
                out.append((n, "normalized_only_no_source_offsets", None, None, *span))
        return out


def align_quotes(texts: DataFrame, quotes: DataFrame, normalized: bool = True, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """(quote_id, text_id, status, char_start, char_end, near_start, near_end): every quote with every text that holds it.

    ``texts``: text_id, text; ``quotes``: quote_id, quote, ids unique. Status is exact_unique (with offsets), ambiguous,
    normalized_only_no_source_offsets (equal after compatibility normalisation without white space; ``near_*`` say where
    in the raw text, if it is the only such place), or for a quote that no text holds, unmatched or empty, with a null
    text_id. Each text is read once for each ``limit`` bytes of quotes. Offsets count code points.
    """
    spark = texts.sparkSession
    listed = stage(quotes.select("quote_id", F.coalesce("quote", F.lit("")).alias("quote")), "quotes")
    blocks = 1 + measured_bytes(listed) // limit
    quote_type, text_type = dict(listed.dtypes)["quote_id"], dict(texts.dtypes)["text_id"]
    from citefold.operators.dense import _arrow_schema

    schema = (f"quote_id {quote_type}, text_id {text_type}, status string, char_start int, char_end int, near_start int, near_end int")
    arrow = _arrow_schema(spark, schema)
    found = None
    for block in range(blocks):
        own = listed.filter((F.pmod(F.xxhash64("quote_id"), F.lit(blocks)) == block) & (F.col("quote") != ""))
        held = [(r.quote_id, r.quote) for r in own.collect()]  # a measured block
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = QuoteAutomaton(shared.value, normalized)
            for batch in batches:
                rows = []
                for number, text in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist()):
                    rows += [(q, number, *rest) for q, *rest in automaton.align(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                    zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

        part = texts.select("text_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    found = stage(found, "aligned-quotes")
    none = lambda kind: F.lit(None).cast(kind)
    rest = listed.join(found.select("quote_id").distinct(), "quote_id", "left_anti").select(
        "quote_id", none(text_type).alias("text_id"), F.when(F.col("quote") == "", "empty").otherwise("unmatched").alias("status"),
        *[none("int").alias(c) for c in ("char_start", "char_end", "near_start", "near_end")])
    return found.unionByName(rest)
