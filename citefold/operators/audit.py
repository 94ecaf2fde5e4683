"""Lexical answer audit: quantities, scopes, signs, absence claims, reaction equations."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from citefold.functions.text import SPACE
from citefold.operators.citations import gather, unresolved
from citefold.session import TEXT_CODEC, stage

# Question words that ask for a kind of quantity.
SCOPES = {
    "potential": "电位|电压|potential|voltage|overpotential",
    "current": "电流|current",
    "rate": "产率|生产速率|productivity|production rate|yield rate",
    "efficiency": "法拉第|选择性|收率|\\bFE\\b|efficiency|selectivity|yield",
    "concentration": "浓度|电解液|摩尔比|当量|concentration|electrolyte|ratio|equiv|loading",
    "temperature": "温度|temperature",
    "time": "时间|多久|稳定|duration|stability|how long|time",
}
ANY_SCOPE = "条件|性能|数值|参数|conditions?|performance|parameters?|metrics?"

# Unit prefix to scope, tried in this order.
UNIT_SCOPES = [
    ("mV", "potential"), ("V", "potential"), ("mA", "current"), ("A", "current"), ("μmol", "rate"),
    ("mmol", "rate"), ("%", "efficiency"), ("mol%", "concentration"), ("mol", "concentration"),
    ("mM", "concentration"), ("M", "concentration"), ("equiv", "concentration"), ("°C", "temperature"),
    ("K", "temperature"), ("min", "time"), ("h", "time"), ("s", "time"),
]

# Quantity grammar and claim patterns.
_S = f"[{SPACE}]"
QUANTITY = (
    "(?=[+−\\p{Nd}-])(?<![A-Za-z0-9_.+−-])([+−-]?\\p{Nd}+(?:\\.\\p{Nd}+)?(?:[eE][+-]?\\p{Nd}+)?)" + _S + "*"
    "(mol%|(?:μmol|mmol|mA|A)(?:(?:" + _S + "*cm" + _S + "*\\^?" + _S + "*-?2)|(?:" + _S + "*/" + _S + "*cm\\^?2))?"
    "(?:" + _S + "*h" + _S + "*\\^?" + _S + "*-1)?|equiv|mM|mV|min|°" + _S + "*C|V|M|mol|%|K|h|s)(?![A-Za-z])"
)
ABSENCE = (
    "(?i)(?:全文|整篇论文|整个语料).{0,16}(?:没有|不存在|未报告|未提供)"
    "|(?:原文|论文).{0,8}(?:没有|不存在).{0,8}(?:对照|证据)"
    "|(?:paper|article)\\s+(?:contains no|has no)\\s+(?:controls?|evidence)"
    "|no control experiments?\\s+(?:exist|were performed)"
)
SCOPED_ABSENCE = "(?i)当前片段|检索片段|本次证据|provided (?:excerpts|context)|retrieved (?:excerpts|context)"
ANOMALY = "(?i)原文异常|需(?:要)?核查|疑似错误|不能按有效|source anomaly|requires verification"
PERCENT_TOPIC = "(?i)\\bFE\\b|efficiency|selectivity|选择性|收率|效率"
CHANGE_WORDS = "(?i)变化|下降|降低|change|decreas|relative|delta|百分点"
SENTENCE_END = "[。！？;；\\n]|(?<![0-9])\\.(?![0-9])"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
ABSENCE_WORDS = ("全文", "整篇论文", "整个语料", "原文", "论文", "paper", "article", "no control")  # every absence claim has one
ARROW = "→|⟶|->|\\\\(?:long)?rightarrow"
ARROWS = ("→", "⟶", "->", "\\rightarrow", "\\longrightarrow")  # the same one by one
PLUS = "[+•·]|\\\\(?:bullet|cdot)"
ASKS_EQUATION = "(?i)方程|反应式|equation|reaction scheme"
CANONICAL_MARKER = "\\[Ref (chunk_[a-f0-9]{64})\\]"
APART = "\x00"  # between the texts cited by one paragraph: no quantity reaches over it, and it bounds words like a text's end


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_S}+|{_S}+$", "")


_quantity = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]:>04}", QUANTITY).replace("\\p{Nd}", "\\d"))
_number = re.compile("([+-]?)(\\d+)(?:\\.(\\d+))?(?:[eE]([+-]?\\d+))?")
_spaces = re.compile(r"\s+")
KEPT_QUANTITIES = 50_000


def _amount(found: str) -> tuple[str, str, str]:
    """(value, shown, unit) of one match of ``QUANTITY`` in a comparable text."""
    m = _number.match(found)
    sign, whole, fraction, power = m.groups("")
    unit = _spaces.sub("", found[m.end():]).replace("^", "").replace("/cm2", "cm-2")
    digits = (whole + fraction).lstrip("0")
    short = digits.rstrip("0")
    power = ("-" if power.startswith("-") else "") + (power.lstrip("+-").lstrip("0") or "0")
    if not short:
        value = "0"
    elif len(power.lstrip("-")) > 28:  # such powers are compared as they are written
        value = m.group()
    else:
        value = f"{'-' if sign == '-' else ''}{short}E{int(power) + len(digits) - len(short) - len(fraction)}"
    return value, m.group(), unit


@F.arrow_udf(ArrayType(StructType([StructField(name, StringType()) for name in ("value", "shown", "unit")])))
def quantities(text: pa.Array) -> pa.Array:
    """array<struct<value, shown, unit>> of a text in its comparable form, all of them strings.

    ``value`` is sign, digits without outer zeros and exponent: equal for equal numbers of any size and precision, and
    it starts with "-" only where the number is below zero.
    """
    known: dict[str, tuple[str, str, str]] = {}
    amounts, ends = [], [0]
    for t in text.to_pylist():
        if t is not None:
            if not t.isascii():
                t = unicodedata.normalize("NFKC", t).replace("−", "-")
            for m in _quantity.finditer(t):
                found = m.group()
                amount = known.get(found)
                if amount is None:
                    if len(known) >= KEPT_QUANTITIES:
                        known.clear()
                    amount = known[found] = _amount(found)
                amounts.append(amount)
        ends.append(len(amounts))
    parts = [pa.array(c, pa.string()) for c in zip(*amounts)] or [pa.array([], pa.string())] * 3
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["value", "shown", "unit"]),
                                    mask=text.is_null())


def negative_percentage(found: Column) -> Column:
    return F.exists(found, lambda q: F.startswith(q["value"], F.lit("-")) & (q["unit"] == "%"))


def unit_scope(unit: Column) -> Column:
    return reduce(lambda c, p: c.when(F.startswith(unit, F.lit(p[0])), p[1]), UNIT_SCOPES[1:],
                  F.when(F.startswith(unit, F.lit(UNIT_SCOPES[0][0])), UNIT_SCOPES[0][1]))


def requested_scopes(question: Column) -> Column:
    """Kinds of quantity the question asks for; a generic question asks for all of them."""
    named = F.array_compact(F.array(*[
        F.when(question.rlike("(?i)" + p), F.lit(name)) for name, p in SCOPES.items()]))
    return F.when(question.rlike("(?i)" + ANY_SCOPE), F.array(*[F.lit(n) for n in SCOPES])).otherwise(named)


def audit(answers: DataFrame, context: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, value, unit, text): one row per finding.

    ``answers``: keys, question, answer. ``context``: keys, chunk_id, chunk_index, sources, text.
    Answers meet their contexts once. Paragraphs are cut, and their quantities and those of the chunks
    they cite extracted, in the same pass; what is staged of them is what the rules need, the text
    only where a rule about its wording can apply.
    """
    empty = lambda kind="string": F.lit(None).cast(kind)
    ids = lambda p: F.regexp_extract_all(p, F.lit(CANONICAL_MARKER), 1)
    quoting = F.transform(F.split("answer", f"\\n{_S}*\\n", -1), lambda p: F.struct(p.alias("paragraph"), ids(p).alias("ids")))
    quoting = F.transform(quoting, lambda p: F.struct(p["paragraph"].alias("paragraph"), F.filter(
        F.col("context"), lambda c: F.array_contains(p["ids"], c["chunk_id"]))["text"].alias("cited")))
    cut = gather(answers, context, keys).select(
        *keys, requested_scopes(F.col("question")).alias("scopes"),
        F.col("question").rlike(ASKS_EQUATION).alias("asked"),
        unresolved(F.col("answer"), F.col("context")).alias("_unresolved"), quoting.alias("_paragraphs"))
    cut = cut.select(*keys, "scopes", "asked", "_unresolved", F.posexplode("_paragraphs").alias("_p", "_of")).select(
        *keys, "scopes", "asked", "_p", F.when(F.col("_p") == 0, F.col("_unresolved")).alias("_unresolved"), "_of.*")
    whole = F.col("paragraph")
    read = (
        cut.withColumn("_quantities", quantities(whole))
        .withColumn("_amounts", quantities(F.array_join("cited", APART)))
        .withColumn("negative", negative_percentage(F.col("_quantities")) & whole.rlike(PERCENT_TOPIC))
        .withColumn("absent", contains_any(F.lower(whole), ABSENCE_WORDS) & whole.rlike(ABSENCE))
        .withColumn("reaction", contains_any(whole, ARROWS)))
    paragraphs = stage(read.withColumns({
        "paragraph": F.when(F.col("negative") | F.col("absent") | F.col("reaction"), whole),
        "cited": F.when(F.col("reaction"), F.col("cited"))}), "paragraphs", TEXT_CODEC)
    at = [*keys, "_p"]
    missing = paragraphs.select(*keys, F.inline("_unresolved")).select(
        *keys, F.lit("unresolved_citation").alias("code"), F.col("reason").alias("value"),
        empty().alias("unit"), F.col("marker").alias("text"))
    claimed = paragraphs.select(*at, "scopes", "_amounts", F.inline("_quantities")).withColumnsRenamed({"value": "amount", "shown": "value"})
    finding = lambda df, code: df.select(*keys, F.lit(code).alias("code"), "value", "unit", empty().alias("text"))
    unrequested = finding(claimed.filter(~F.array_contains("scopes", unit_scope(F.col("unit")))), "unrequested_quantity")
    supported = F.exists("_amounts", lambda a: (a["value"] == F.col("amount")) & (a["unit"] == F.col("unit")))
    unsupported = finding(claimed.filter(~supported), "quantity_not_in_cited_excerpt")

    sentences = lambda flag: paragraphs.filter(flag).select(
        *keys, F.explode(F.split("paragraph", SENTENCE_END, -1)).alias("sentence"))
    prose = lambda df, code: df.select(*keys, F.lit(code).alias("code"), empty().alias("value"), empty().alias("unit"),
                                       stripped(F.col("sentence")).alias("text"))
    s = F.col("sentence")
    negative = prose(
        sentences("negative").filter(s.rlike(PERCENT_TOPIC) & ~s.rlike(CHANGE_WORDS) & ~s.rlike(ANOMALY))
        .filter(negative_percentage(quantities(s))),
        "unflagged_negative_percentage")
    absence = prose(sentences("absent").filter(s.rlike(ABSENCE) & ~s.rlike(SCOPED_ABSENCE)), "unbounded_evidence_absence")

    bare = stripped(F.regexp_replace("line", "\\[Ref [^\\]]+\\]", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, "^[`$]+|[`$]+$", ""), f"^{_S}*(?:[-*]|[0-9]+\\.){_S}+", "")
    equations = (
        paragraphs.filter("reaction")
        .select(*keys, "asked", "cited", F.explode(F.split("paragraph", LINE_END, -1)).alias("line"))
        .filter(F.col("line").rlike(ARROW) & F.col("line").rlike(PLUS))
        .withColumn("compact", F.regexp_replace(bare, f"{_S}+", "")))
    shown = F.col("asked") & (F.col("compact") != "") & F.exists(
        "cited", lambda t: F.contains(F.regexp_replace(t, f"{_S}+", ""), F.col("compact")))
    unverified = equations.filter(~F.coalesce(shown, F.lit(False))).select(
        *keys, F.lit("unverified_reaction_equation").alias("code"), empty().alias("value"),
        empty().alias("unit"), stripped(F.col("line")).alias("text"))
    return reduce(DataFrame.unionByName, [missing, unrequested, unsupported, negative, absence, unverified])


def audit_status(answers: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, findings): an answer with any finding is blocked."""
    counts = findings.groupBy(*keys).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return answers.select(*keys).join(counts, keys, "left").select(
        *keys, F.when(n > 0, "blocked").otherwise("passed_lexical_checks").alias("status"), n.cast("long").alias("findings"))
