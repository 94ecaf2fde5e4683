"""Evidence serialization, prompts, request budgets and greedy whole-chunk selection."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citefold.functions.identity import basename
from citefold.functions.text import ascii_json_length, clean_text, json_string
from citefold.operators.intervals import union_length

CONTEXT_VERSION = "evidence-context-1"
DEFAULT_TEMPLATE = "Field: {domain}\n\nEvidence:\n{context}\n\nQuestion: {question}\n"


@dataclass(frozen=True)
class Policy:
    """Selection limits; sizes are bytes of the serialized request."""

    candidate_window: int = 50
    max_chunks: int = 10
    max_chunks_per_document: int = 6
    maximum_existing_span_overlap: float = 0.5
    input_estimate_limit: int = 32_000
    output_token_limit: int = 4_096
    protocol_token_reserve: int = 1_024
    total_estimate_limit: int = 40_000

    def __post_init__(self):
        values = asdict(self)
        overlap = values.pop("maximum_existing_span_overlap")
        if any(type(v) is not int or v <= 0 for v in values.values()):
            raise ValueError("limits must be positive integers")
        if isinstance(overlap, bool) or not 0 <= overlap <= 1:
            raise ValueError("overlap must be a fraction")
        if (self.candidate_window != 50 or self.max_chunks > 50
                or self.max_chunks_per_document > self.max_chunks
                or self.input_estimate_limit + self.output_token_limit + self.protocol_token_reserve
                > self.total_estimate_limit):
            raise ValueError("inconsistent selection policy")


def evidence_record(chunk) -> Column:
    """One evidence entry of the context document, indented as it appears there."""
    located = chunk["location_status"] == "located"
    field = lambda name, value: F.concat(F.lit(f'      "{name}": '), value)
    pages = F.when(
        located & (F.size(chunk["page_numbers"]) > 0),
        F.concat(F.lit("[\n"), F.array_join(F.transform(
            chunk["page_numbers"], lambda p: F.concat(F.lit("        "), p.cast("string"))), ",\n"), F.lit("\n      ]")),
    ).otherwise("[]")
    title = F.coalesce(F.when(chunk["title"] != "", chunk["title"]), basename(chunk["source"]))
    lines = [
        field("citation", json_string(F.concat(F.lit("[Ref "), chunk["chunk_id"], F.lit("]")))),
        field("chunk_id", json_string(chunk["chunk_id"])),
        field("doc_id", json_string(chunk["doc_id"])),
        field("source_title", json_string(title)),
        field("location_status", json_string(chunk["location_status"])),
        field("page_numbers", pages),
        field("text", json_string(chunk["text"])),
        F.when(chunk["location_status"] == "unavailable", field("location_reason", json_string(
            F.coalesce(chunk["location_reason"], F.lit("page_text_not_supplied"))))),
    ]
    return F.concat(F.lit("    {\n"), F.concat_ws(",\n", *lines), F.lit("\n    }"))


def context_document(records: Column) -> Column:
    """Whole context document from array<string> of evidence records in order."""
    body = F.when(F.size(records) > 0, F.concat(F.lit("[\n"), F.array_join(records, ",\n"), F.lit("\n  ]"))).otherwise("[]")
    return F.concat(
        F.lit(f'{{\n  "context_version": "{CONTEXT_VERSION}",\n  "evidence_count": '),
        F.size(records).cast("string"), F.lit(',\n  "evidence": '), body, F.lit("\n}"))


def render_prompt(template: str, domain: str, context: Column, question: Column) -> Column:
    """Fill the three placeholders once each; filled-in text is never scanned again."""
    fills = {"{domain}": F.lit(domain), "{context}": context, "{question}": question}
    parts, rest = [], template
    while rest:
        at = {rest.find(k): k for k in fills if k in rest}
        if not at:
            parts.append(F.lit(rest))
            break
        first = min(at)
        parts += [F.lit(rest[:first]), fills[at[first]]]
        rest = rest[first + len(at[first]):]
    return F.concat(*parts)


def request_bytes(prompt: Column, body: dict) -> Column:
    """Bytes of the JSON request carrying the prompt as its only user message."""
    frame = json.dumps({**body, "messages": [{"role": "user", "content": ""}]}, allow_nan=False)
    return F.lit(len(frame)) + ascii_json_length(prompt)


def span_overlap(chunk, taken: Column) -> Column:
    """Fraction of a located chunk's source characters inside array<struct<doc,page,s,e>>."""
    total = F.aggregate(chunk["source_spans"], F.lit(0).cast("long"), lambda t, s: t + (s.char_end - s.char_start))
    repeated = F.aggregate(
        chunk["source_spans"], F.lit(0).cast("long"),
        lambda t, span: t + union_length(F.transform(
            F.filter(taken, lambda o: (o.doc == chunk["doc_id"]) & (o.page == span.page_number)
                     & (o.s < span.char_end) & (o.e > span.char_start)),
            lambda o: F.struct(F.greatest(o.s, span.char_start.cast("long")).alias("s"),
                               F.least(o.e, span.char_end.cast("long")).alias("e")))))
    return F.when((chunk["location_status"] == "located") & (total > 0), repeated / total).otherwise(F.lit(0.0))


def select_evidence(hits: DataFrame, questions: DataFrame, policy: Policy, body: dict,
                    template: str = DEFAULT_TEMPLATE, domain: str = "general", keys: list[str] | None = None) -> DataFrame:
    """Greedy selection per question: (keys, rank, chunk_id, doc_id, selected, reason, overlap, input_estimate).

    Candidates are walked in rank order by one fold per question over its candidate window. The
    size of a request is additive - an empty request plus each record plus separators - so a step
    costs one addition instead of rendering the prompt again.
    """
    if body.get("max_tokens") != policy.output_token_limit:
        raise ValueError("output budget of the request differs from the policy")
    keys = keys or ["question_id"]
    empty = request_bytes(render_prompt(template, domain, context_document(F.array().cast("array<string>")),
                                        F.col("question")), body)
    base = questions.select(*[k for k in keys if k in questions.columns], empty.alias("_base"))
    row = lambda name: F.col(name)
    chunk = {c: row(c) for c in hits.columns}
    prepared = hits.select(
        *keys, F.struct(
            "rank", "chunk_id", "doc_id", "location_status",
            F.transform("source_spans", lambda s: F.struct(
                s.page_number.alias("page_number"), s.char_start.alias("char_start"),
                s.char_end.alias("char_end"))).alias("source_spans"),
            F.sha2(clean_text(F.col("text")), 256).alias("text_hash"),
            ascii_json_length(evidence_record(chunk)).cast("long").alias("size")).alias("c"))
    grouped = prepared.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    over = F.when(F.size("cs") > policy.candidate_window,
                  F.raise_error(F.lit("candidate window exceeded"))).otherwise(F.col("cs"))
    state_type = (
        "struct<n:int,size:bigint,ids:array<string>,texts:array<string>,docs:array<string>,"
        "taken:array<struct<doc:string,page:int,s:bigint,e:bigint>>,"
        "log:array<struct<rank:int,chunk_id:string,doc_id:string,selected:boolean,reason:string,overlap:double>>>")
    start = F.struct(
        F.lit(0).alias("n"), F.col("_base").cast("long").alias("size"),
        *[F.array().cast("array<string>").alias(a) for a in ("ids", "texts", "docs")],
        F.array().cast("array<struct<doc:string,page:int,s:bigint,e:bigint>>").alias("taken"),
        F.array().cast("array<struct<rank:int,chunk_id:string,doc_id:string,selected:boolean,reason:string,overlap:double>>").alias("log"),
    ).cast(state_type)

    def grown(st, c):
        """Request size with one more record: list brackets once, separators after, count digits."""
        brackets = F.when(st.n == 0, F.lit(6)).otherwise(F.lit(3))
        digits = F.length((st.n + 1).cast("string")) - F.length(st.n.cast("string"))
        return st["size"] + c["size"] + brackets + digits

    def verdict(st, c, overlap):
        same_doc = F.size(F.filter(st.docs, lambda d: d == c.doc_id))
        return (
            F.when(F.array_contains(st.ids, c.chunk_id), "duplicate_chunk_id")
            .when(F.array_contains(st.texts, c.text_hash), "duplicate_text")
            .when(overlap > policy.maximum_existing_span_overlap, "source_span_overlap")
            .when(st.n >= policy.max_chunks, "chunk_limit")
            .when(same_doc >= policy.max_chunks_per_document, "document_limit")
            .when(grown(st, c) > policy.input_estimate_limit, "input_budget"))

    def step(st, c):
        def decided(d):
            take = d.reason.isNull()
            more = lambda old, new: F.when(take, F.concat(old, new)).otherwise(old)
            return F.struct(
                (st.n + take.cast("int")).alias("n"),
                F.when(take, grown(st, c)).otherwise(st["size"]).alias("size"),
                F.array_append(st.ids, c.chunk_id).alias("ids"),
                F.array_append(st.texts, c.text_hash).alias("texts"),
                more(st.docs, F.array(c.doc_id)).alias("docs"),
                more(st.taken, F.when(c.location_status == "located", F.transform(c.source_spans, lambda s: F.struct(
                    c.doc_id.alias("doc"), s.page_number.alias("page"), s.char_start.cast("long").alias("s"),
                    s.char_end.cast("long").alias("e")))).otherwise(F.filter(st.taken, lambda x: F.lit(False)))).alias("taken"),
                F.array_append(st.log, F.struct(
                    c["rank"].alias("rank"), c.chunk_id.alias("chunk_id"), c.doc_id.alias("doc_id"),
                    take.alias("selected"), d.reason.alias("reason"), d.overlap.alias("overlap"))).alias("log"),
            ).cast(state_type)

        # one-element arrays bind an intermediate value, which SQL lambdas cannot otherwise do
        with_overlap = F.transform(F.array(span_overlap(c, st.taken)), lambda o: F.struct(
            verdict(st, c, o).alias("reason"), o.alias("overlap")))
        return F.transform(with_overlap, decided)[0]

    folded = (grouped.join(base, [k for k in keys if k in questions.columns])
              .withColumn("_end", F.aggregate(over, start, step)))
    return (
        folded.filter(F.when(F.col("_base") > policy.input_estimate_limit, F.raise_error(F.lit(
            "question and template alone exceed the input budget"))).otherwise(True))
        .select(*keys, F.col("_end.size").alias("input_estimate"), F.inline("_end.log"))
    )


def exclusion_histogram(selection: DataFrame, keys: list[str]) -> DataFrame:
    return selection.filter("not selected").groupBy(*keys, "reason").agg(F.count("*").alias("excluded"))


def prepared_prompts(selected: DataFrame, questions: DataFrame, body: dict, template: str = DEFAULT_TEMPLATE,
                     domain: str = "general") -> DataFrame:
    """(question_id, chunk_ids, prompt, request_bytes): the full rendering of the chosen evidence."""
    chunk = {c: F.col(c) for c in selected.columns}
    evidence = selected.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "chunk_id", evidence_record(chunk).alias("record")))).alias("_e"))
    joined = questions.join(evidence, "question_id", "left")
    records = F.coalesce(F.transform("_e", lambda e: e.record), F.array().cast("array<string>"))
    prompt = render_prompt(template, domain, context_document(records), F.col("question"))
    return (joined.select("question_id", F.coalesce(F.transform("_e", lambda e: e.chunk_id),
                                                     F.array().cast("array<string>")).alias("chunk_ids"), prompt.alias("prompt"))
            .withColumn("request_bytes", request_bytes(F.col("prompt"), body)))


def repeated_source_fraction(chunks: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """Share of located source characters already seen earlier in each ordered list.

    Repetition of an ordered list equals its total length minus its union, so no chunk is
    compared with its predecessors.
    """
    spans = (chunks.filter(F.col("location_status") == "located")
             .select(*keys, "doc_id", F.inline("source_spans")))
    per_page = spans.groupBy(*keys, "doc_id", "page_number").agg(
        F.sum((F.col("char_end") - F.col("char_start")).cast("long")).alias("_total"),
        union_length(F.collect_list(F.struct(F.col("char_start").cast("long").alias("s"),
                                             F.col("char_end").cast("long").alias("e")))).alias("_union"))
    return per_page.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_total") - F.col("_union")).cast("double"), F.sum("_total")).alias("source_character_overlap_fraction"),
        F.sum("_total").alias("source_characters"))


def prompt_guard(prepared: DataFrame, questions: DataFrame, version: str, template_hash: str) -> DataFrame:
    """(question_id, verdict) of prompts (question_id, question_hash, prompt_version, template_sha256) before they are sent.

    A prompt is sent only for the question it was prepared from, under the expected policy and template.
    """
    joined = prepared.join(questions.select("question_id", F.sha2("question", 256).alias("_q")), "question_id", "left")
    same = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    return joined.select("question_id", F.when(F.col("_q").isNull(), "unknown_question")
                         .when(~same("question_hash", F.col("_q")), "other_question")
                         .when(~same("prompt_version", F.lit(version)), "other_policy")
                         .when(~same("template_sha256", F.lit(template_hash)), "other_template")
                         .otherwise("accepted").alias("verdict"))
