"""Text expressions: cleaning, counting, JSON escaping and byte-exact size arithmetic."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace set (Java and RE2 `\s` are ASCII only).
SPACE = (
    "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
# Word characters are letters, numbers and underscore; marks are not included.
WORD = "\\p{L}\\p{N}_"
DROPPED_SYMBOL = f"[^{WORD}{SPACE},.?;:!-]"
DEFAULT_TOKEN = f"[{WORD}]+|[^{WORD}{SPACE}]"


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def clean_text(text: Column) -> Column:
    """Every whitespace run becomes one space; ends are stripped; symbols stay."""
    return F.trim(collapse_spaces(text))


def clean_text_dropping_symbols(text: Column) -> Column:
    """Historical cleaning: symbols vanish after the space collapse, leaving their spaces."""
    return F.trim(F.regexp_replace(collapse_spaces(text), DROPPED_SYMBOL, ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), 0)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_count(text: Column, pattern: str = DEFAULT_TOKEN, special_tokens: int = 2) -> Column:
    """Token count of the default regular-expression tokenizer, special tokens included."""
    return F.size(F.regexp_extract_all(text, F.lit(pattern), 0)) + F.lit(special_tokens)


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


# ---- JSON -----------------------------------------------------------------------------------

_SHORT_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                  ("\b", "\\b"), ("\f", "\\f")]
_OTHER_CONTROLS = [c for c in map(chr, range(32)) if c not in "\n\r\t\b\f"]
_OTHER_CONTROL_CLASS = "\\x00-\\x07\\x0b\\x0e-\\x1f"


def json_string(text: Column) -> Column:
    """JSON string literal with non-ASCII kept and lower-case control escapes."""
    def escaped(col, pairs):
        return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)

    common = escaped(text, _SHORT_ESCAPES)
    rare = escaped(common, [(c, f"\\u{ord(c):04x}") for c in _OTHER_CONTROLS])
    return F.concat(
        F.lit('"'),
        F.when(text.rlike('[\\x00-\\x1f"\\\\]'), F.when(text.rlike(f"[{_OTHER_CONTROL_CLASS}]"), rare).otherwise(common))
        .otherwise(text),
        F.lit('"'),
    )


def _occurrences(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]", ""))


def ascii_json_length(text: Column) -> Column:
    """Bytes of the text inside an ASCII-only JSON string (quotes not counted).

    Plain ASCII costs 1, short escapes 2, other controls and U+007F 6, other characters of
    the basic plane 6, supplementary characters 12 (a surrogate pair).
    """
    return (
        F.length(text)
        + _occurrences(text, '"\\\\\\n\\r\\t\\x08\\f')
        + 5 * _occurrences(text, _OTHER_CONTROL_CLASS + "\\x7f")
        + 5 * _occurrences(text, "\\x{80}-\\x{ffff}")
        + 11 * _occurrences(text, "\\x{10000}-\\x{10ffff}")
    )


# ---- statuses and small rules ---------------------------------------------------------------

# The generation states a record may state explicitly.
STATUSES = ["success", "no_evidence", "failed", "truncated", "pending"]


def execution_status(status: Column) -> Column:
    """Anything but a known state is `unverified`, never inferred to be successful."""
    return F.when(status.isin(STATUSES), status).otherwise(F.lit("unverified"))


def evidence_route(evidence_count: Column) -> Column:
    """Empty evidence takes the local route and sends no request."""
    return F.when(evidence_count > 0, F.lit("model_request")).otherwise(F.lit("local_no_evidence"))


def unique_alignment(raw: Column, quote: Column) -> Column:
    """Where an exact quotation sits in a text: struct(status, char_start, char_end).

    Only a single exact occurrence yields offsets; a match that appears only after NFKC and
    whitespace removal is reported without offsets.
    """
    from citefold.functions.analyzer import nfkc

    first = F.call_function("locate", quote, raw)
    second = F.call_function("locate", quote, raw, first + 1)
    squeeze = lambda c: F.regexp_replace(nfkc(c), f"[{SPACE}]+", "")
    needle = squeeze(quote)
    status = (
        F.when(quote.isNull() | (quote == ""), "empty")
        .when((first > 0) & (second > 0), "ambiguous")
        .when(first > 0, "exact_unique")
        .when((needle != "") & F.contains(squeeze(raw), needle), "normalized_only_no_source_offsets")
        .otherwise("unmatched")
    )
    unique = status == "exact_unique"
    return F.struct(
        status.alias("status"),
        F.when(unique, first - 1).alias("char_start"),
        F.when(unique, first - 1 + F.length(quote)).alias("char_end"),
    )


def valid_bbox(left: Column, top: Column, right: Column, bottom: Column, origin: Column,
               width: Column, height: Column) -> Column:
    """Box lies on the page and its edges are ordered the way its origin demands."""
    return F.coalesce(
        origin.isin("TOPLEFT", "BOTTOMLEFT")
        & (left >= 0) & (left <= right) & (right <= width)
        & (F.least(top, bottom) >= 0) & (F.greatest(top, bottom) <= height)
        & F.when(origin == "TOPLEFT", top <= bottom).otherwise(bottom <= top),
        F.lit(False),
    )


def canonical_request(model: str, system: Column, user: Column) -> Column:
    """JSON of a two-message request with sorted keys and the usual separators; the same request, the same text."""
    message = lambda role, content: F.concat(F.lit('{"content": '), json_string(content), F.lit(f', "role": "{role}"}}'))
    return F.concat(F.lit('{"messages": ['), message("system", system), F.lit(", "), message("user", user),
                    F.lit(f'], "model": {json.dumps(model)}}}'))


def request_digest(model: str, system: Column, user: Column) -> Column:
    return F.sha2(canonical_request(model, system, user), 256)
