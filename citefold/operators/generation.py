"""Remote generation behind a pluggable sender: one attempt, retries, gates, batch runs."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.functions.text import evidence_route
from citefold.operators.dense import _arrow_schema

# What may be retried, which finish reasons are known, which counters are kept.
TRANSIENT_HTTP = (429, 500, 502, 503, 504)
INCOMPLETE_REASONS = ("length", "content_filter", "tool_calls", "insufficient_system_resource", "aborted")
USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_cache_hit_tokens", "prompt_cache_miss_tokens")

RESULT_SCHEMA = (
    "question_id {}, status string, content string, partial_content string, error_code string, retryable boolean, "
    "request_sent boolean, attempts int, http_status int, finish_reason string, usage map<string,bigint>, "
    "elapsed_seconds double, attempt_history array<struct<attempt:int,status:string,error_code:string,http_status:int>>"
)
NO_EVIDENCE_ANSWER = "The current retrieval returned no usable evidence for this question."


class SendTimeout(Exception):
    """The sender gave up waiting."""


class SendFailure(Exception):
    """The request did not reach the service or its answer did not come back."""


@dataclass(frozen=True)
class RequestSettings:
    model: str
    max_tokens: int = 4_096
    thinking: str = "disabled"
    temperature: float = 0.2
    max_attempts: int = 3
    connect_timeout: float = 10.0
    read_timeout: float = 120.0

    def __post_init__(self):
        number = lambda v: type(v) in (int, float) and math.isfinite(v)
        if not (
            isinstance(self.model, str) and self.model.strip()
            and self.thinking in ("enabled", "disabled")
            and type(self.max_tokens) is int and self.max_tokens > 0
            and type(self.max_attempts) is int and 1 <= self.max_attempts <= 5
            and number(self.temperature) and 0 <= self.temperature <= 2
            and number(self.connect_timeout) and self.connect_timeout > 0
            and number(self.read_timeout) and self.read_timeout > 0
        ):
            raise ValueError("invalid generation settings")

    @property
    def body(self) -> dict:
        extra = {"temperature": self.temperature} if self.thinking == "disabled" else {}
        return {"model": self.model, "thinking": {"type": self.thinking}, "max_tokens": self.max_tokens,
                "stream": False, **extra}


def _failed(code: str, retryable: bool = False, **more) -> dict:
    return {"status": "failed", "error_code": code, "retryable": retryable, **more}


def read_reply(http_status: int, reply: object) -> dict:
    """Outcome of one HTTP reply; anything unexpected is an invalid response, never an answer."""
    seen: dict = {"http_status": http_status}
    if http_status != 200:
        return _failed("rate_limit" if http_status == 429 else "http", http_status in TRANSIENT_HTTP, **seen)
    if not isinstance(reply, dict) or reply.get("error") is not None:
        return _failed("invalid_response", **seen)
    if isinstance(reply.get("usage"), dict):
        seen["usage"] = {k: v for k, v in reply["usage"].items() if k in USAGE_FIELDS and type(v) is int and v >= 0}
    choices = reply.get("choices")
    choice = choices[0] if isinstance(choices, list) and len(choices) == 1 else None
    message = choice.get("message") if isinstance(choice, dict) else None
    reason = choice.get("finish_reason") if isinstance(choice, dict) else None
    if not isinstance(message, dict) or not isinstance(reason, str):
        return _failed("invalid_response", **seen)
    seen["finish_reason"] = reason
    content, thought = message.get("content"), message.get("reasoning_content")
    if any(x is not None and not isinstance(x, str) for x in (content, thought)):
        return _failed("invalid_response", **seen)
    if reason in INCOMPLETE_REASONS:
        cut = reason == "length"
        return {"status": "truncated" if cut else "failed", "error_code": "length" if cut else "incomplete",
                "retryable": reason == "insufficient_system_resource", "partial_content": content, **seen}
    proper = (reason == "stop" and not message.get("refusal") and not message.get("tool_calls")
              and message.get("role", "assistant") == "assistant" and content and content.strip())
    return {"status": "success", "content": content, "retryable": False, **seen} if proper else _failed("invalid_response", **seen)


def generate_one(prompt: str, settings: RequestSettings, send: Callable, sleep=time.sleep, clock=time.perf_counter) -> dict:
    """Send with bounded retries; waits 1, 2, 4, 8 seconds and only after transient faults."""
    if not isinstance(prompt, str) or not prompt.strip():
        raise ValueError("a prompt needs text")
    payload = {**settings.body, "messages": [{"role": "user", "content": prompt}]}
    started, history, outcome = clock(), [], {}
    for attempt in range(1, settings.max_attempts + 1):
        try:
            outcome = read_reply(*send(payload))
        except SendTimeout:
            outcome = _failed("timeout", True)
        except SendFailure:
            outcome = _failed("network", True)
        history.append({"attempt": attempt, "status": outcome["status"], "error_code": outcome.get("error_code"),
                        "http_status": outcome.get("http_status")})
        if outcome["status"] == "success" or not outcome["retryable"] or attempt == settings.max_attempts:
            break
        sleep(min(2 ** (attempt - 1), 8))
    return {**outcome, "request_sent": True, "attempts": len(history), "attempt_history": history,
            "elapsed_seconds": clock() - started}


def generate(prompts: DataFrame, settings: RequestSettings, sender: Callable[[], Callable], sleep=time.sleep) -> DataFrame:
    """One result row per prompt (question_id, prompt, evidence_count).

    Rows without evidence get the fixed local answer and send nothing. ``sender`` is a factory
    called once per task and returns ``send(payload) -> (http_status, reply)``.
    """
    key = dict(prompts.dtypes)["question_id"]
    routed = prompts.withColumn("route", evidence_route(F.col("evidence_count")))
    arrow = _arrow_schema(prompts.sparkSession, RESULT_SCHEMA.format(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = sender()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["route"] == "local_no_evidence":
                    made = {"status": "no_evidence", "content": NO_EVIDENCE_ANSWER, "retryable": False,
                            "request_sent": False, "attempts": 0, "elapsed_seconds": 0.0, "attempt_history": []}
                else:
                    made = generate_one(row["prompt"], settings, send, sleep)
                rows.append({"question_id": row["question_id"], **made, "usage": list(made.get("usage", {}).items())})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return routed.select("question_id", "prompt", "route").mapInArrow(run, RESULT_SCHEMA.format(key))


def guard(results: DataFrame, audit_status: DataFrame) -> DataFrame:
    """Blocked answers become failures that keep their text as partial content; never retried."""
    joined = results.join(audit_status.select("question_id", F.col("status").alias("_audit")), "question_id", "left")
    blocked = (F.col("status") == "success") & (F.col("_audit") == "blocked")
    blocked = F.coalesce(blocked, F.lit(False))
    changed = {
        "partial_content": F.when(blocked, F.col("content")).otherwise(F.col("partial_content")),
        "error_code": F.when(blocked, "answer_validation").otherwise(F.col("error_code")),
        "retryable": F.col("retryable") & ~blocked,
        "status": F.when(blocked, "failed").otherwise(F.col("status")),
        "content": F.when(blocked, F.lit(None)).otherwise(F.col("content")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in results.columns])


def result_faults(results: DataFrame) -> DataFrame:
    """Rows breaking the result contract, with the rule they break."""
    done = F.col("status").isin("success", "no_evidence")
    text = F.coalesce(F.length(F.trim("content")) > 0, F.lit(False))
    fault = (F.when(~F.col("status").isin("success", "no_evidence", "failed", "truncated"), "unknown_status")
             .when(done & ~text, "completed_without_text")
             .when(~done & (F.col("content").isNotNull() | F.col("error_code").isNull()), "failure_without_code_or_with_answer"))
    return results.select("question_id", fault.alias("fault")).filter("fault is not null")


def http_sender(base_url: str, api_key: str, settings: RequestSettings) -> Callable[[], Callable]:
    """Sender over HTTPS with redirects refused; needs the optional ``requests`` package."""
    def make():
        import requests

        def send(payload: dict):
            try:
                reply = requests.post(
                    f"{base_url}/chat/completions", json=payload, allow_redirects=False,
                    headers={"Authorization": f"Bearer {api_key}", "Content-Type": "application/json"},
                    timeout=(settings.connect_timeout, settings.read_timeout))
            except requests.exceptions.Timeout as error:
                raise SendTimeout from error
            except requests.exceptions.RequestException as error:
                raise SendFailure from error
            try:
                return reply.status_code, reply.json()
            except ValueError:
                return reply.status_code, None

        return send

    return make


def echo_sender():
    """Offline stand-in: answers with the first citation the prompt supplies."""
    import re

    def send(payload: dict):
        prompt = payload["messages"][0]["content"]
        marker = re.search(r"\[Ref chunk_[a-f0-9]{64}\]", prompt)
        text = f"The supplied evidence addresses this {marker.group()}." if marker else "No citation was supplied."
        return 200, {"choices": [{"message": {"role": "assistant", "content": text}, "finish_reason": "stop"}],
                     "usage": {"prompt_tokens": len(prompt.split()), "completion_tokens": len(text.split()),
                               "total_tokens": len(prompt.split()) + len(text.split())}}

    return send

