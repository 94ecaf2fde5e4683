"""Campaign statistics: arm summaries, hierarchical means, bootstrap, exact percentiles."""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citefold.functions.text import execution_status
from citefold.operators.scale import measured_join
from citefold.session import stage

# Usage counters that a provider may report.
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
ACCURACY = 10_000
# Distribution function of Poisson(1) on a grid of seven hexadecimal digits; beyond 12 draws it rounds to 1.
POISSON_STEPS = [int(p * 16**7) for p in accumulate(math.exp(-1) / math.factorial(k) for k in range(12))]


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float],
                      accuracy: int = ACCURACY) -> DataFrame:
    """(keys, probability, quantile) with linear interpolation, exact at any group size.

    A bounded sketch brackets each wanted rank; only distinct values inside a bracket (about
    4/accuracy of a group) are then ordered, and everything below it is merely counted. Built-in
    exact percentiles would hold a whole group's values in one aggregation buffer.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    margin = 2.0 / accuracy
    cuts = sorted({x for p in probabilities for x in (max(0.0, p - margin), min(1.0, p + margin))})
    sketch = rows.groupBy(*by).agg(
        F.percentile_approx("_v", [float(c) for c in cuts], accuracy).alias("_cut"),
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    place = {c: i for i, c in enumerate(cuts)}
    small = F.col("_n") <= 20 * accuracy  # a group this size is ordered whole
    low = lambda c: F.when(small | F.lit(c <= 0), F.col("_min")).otherwise(F.get("_cut", F.lit(place[c])))
    high = lambda c: F.when(small | F.lit(c >= 1), F.col("_max")).otherwise(F.get("_cut", F.lit(place[c])))
    brackets = sketch.select(*by, "_n", F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("probability"), low(max(0.0, p - margin)).alias("lo"),
                 high(min(1.0, p + margin)).alias("hi")) for p in probabilities])).alias("b")).select(*by, "_n", "b.*")
    distinct_values = rows.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    met = measured_join(distinct_values, stage(brackets, "percentile-brackets"), by)
    below = met.groupBy(*by, "probability").agg(
        F.sum(F.when(F.col("_v") < F.col("lo"), F.col("_c")).otherwise(0)).alias("_below"))
    inside = met.filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    upto = Window.partitionBy(*by, "probability").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (inside.withColumn("_upto", F.sum("_c").over(upto)).join(below, [*by, "probability"])
              .withColumn("_last", F.col("_below") + F.col("_upto"))
              .withColumn("_pos", F.col("probability") * (F.col("_n") - 1)))
    at = lambda rank: F.min(F.when(F.col("_last") > rank, F.col("_v")))
    lower, upper = at(F.floor("_pos")), at(F.ceil("_pos"))
    fraction = F.max(F.col("_pos") - F.floor("_pos"))
    out = ranked.groupBy(*by, "probability").agg(
        (lower + fraction * (upper - lower)).alias("_q"),
        ((F.min("_below") <= F.min(F.floor("_pos"))) & upper.isNotNull()).alias("_held"))
    held = F.when(F.col("_held"), F.col("_q")).otherwise(
        F.raise_error(F.lit("a percentile bracket missed its rank; raise the accuracy")).cast("double"))
    return out.select(*keys, "probability", held.alias("quantile"))


def hierarchical_mean(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean of means: ``levels`` runs from the outermost key kept to the innermost averaged first."""
    current, by = df, list(levels)
    while len(by) >= 1:
        current = current.groupBy(*by).agg(F.avg(value).alias(value))
        if len(by) == 1:
            break
        by = by[:-1]
    return current


def penalized_scores(score: Column, major_error: Column, blocked: Column, status: Column) -> dict[str, Column]:
    """strict, penalized and delivered score of one response."""
    strict = F.when(status == "success", score).otherwise(F.lit(0.0))
    penalized = F.when(major_error, F.least(strict, F.lit(0.5))).otherwise(strict)
    return {"strict": strict, "penalized": penalized, "delivered": F.when(blocked, F.lit(0.0)).otherwise(penalized)}


def arm_summary(records: DataFrame, arm: str = "arm") -> DataFrame:
    """Operational summary per arm; sums and ratios stay null where nothing was reported.

    ``records``: arm, question_id, status, request_sent, elapsed_seconds, usage columns, answer,
    marker_occurrences, resolved_marker_occurrences, context_chunk_utilization.
    """
    sent = F.col("request_sent")
    usage = [c for name in USAGE for c in (
        F.sum(F.when(sent, F.col(name))).alias(f"{name}_sum"),
        F.count(F.when(sent, F.col(name))).alias(f"{name}_reported"),
        F.count_if(sent & F.col(name).isNull()).alias(f"{name}_missing"))]
    main = records.groupBy(arm).agg(
        F.count("*").alias("records"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_records") for s in ("success", "no_evidence", "failed", "truncated")],
        F.count_if(sent).alias("sent_requests"), *usage,
        F.sum(F.when(sent, F.col("elapsed_seconds"))).alias("elapsed_total"),
        F.sum("marker_occurrences").alias("marker_occurrences"),
        F.try_divide(F.sum("resolved_marker_occurrences").cast("double"), F.sum("marker_occurrences")).alias("marker_resolution_rate"),
        F.avg("context_chunk_utilization").alias("context_chunk_utilization_mean"),
        F.count("marker_occurrences").alias("citation_statistics_records"))
    median = exact_percentiles(records.filter(sent), [arm], "elapsed_seconds", [0.5]).select(
        arm, F.col("quantile").alias("elapsed_median"))
    return main.join(median, arm, "left")


def answer_uniqueness(records: DataFrame, arm: str = "arm") -> DataFrame:
    """(arm, question_id, successful_repetitions, distinct_exact_answers)."""
    return records.filter(F.col("status") == "success").groupBy(arm, "question_id").agg(
        F.count("*").alias("successful_repetitions"), F.count_distinct(F.sha2("answer", 256)).alias("distinct_exact_answers"))


def claim_rates(claims: DataFrame, arm: str = "arm") -> DataFrame:
    """Citation support and coverage of atomic claims (label, cited flag)."""
    return claims.groupBy(arm).agg(
        F.count("*").alias("claims"), F.count_if("cited").alias("cited_claims"),
        F.count_if(F.col("support_label") == "supported").alias("supported_claims")).select(
        "*", F.try_divide(F.col("supported_claims").cast("double"), "cited_claims").alias("citation_support_rate"),
        F.try_divide(F.col("cited_claims").cast("double"), "claims").alias("factual_citation_coverage"))


def qa_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Batch run summary: status counts, means over successes rounded, 0 when there are none."""
    status = execution_status(F.col("status"))
    ok = status == "success"
    mean = lambda c, d: F.round(F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)), d)
    return records.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"),
        F.count_if(status.isin("failed", "truncated")).alias("failed"),
        F.count_if(status == "truncated").alias("truncated"), F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "unverified").alias("unverified"),
        mean("processing_time", 2).alias("avg_processing_time"), mean("answer_length", 1).alias("avg_answer_length"))


def paired_bootstrap(deltas: DataFrame, keys: list[str], group: str, value: str, samples: int = 10_000,
                     seed: int = 0) -> DataFrame:
    """(keys, difference_pp, low_pp, high_pp, groups, unpaired): 95 % interval of the mean paired difference.

    Every resample gives every group a Poisson(1) weight, drawn from the MD5 of seed, group and resample; weighted sums
    combine per resample, so the groups of a key never meet in one task and any engine can repeat the draw. A null
    value is a group without its pair: it is counted in ``unpaired`` and has no weight. Resamples in which no group
    has weight are left out, and a key without any pair has null figures.
    """
    if samples <= 0:
        raise ValueError("samples must be positive")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    by = keys or ["_all"]
    rows = deltas.select(*(keys or [F.lit(0).alias("_all")]), F.col(group).cast("string").alias("_g"), F.when(
        bad, F.raise_error(F.lit("finite paired differences required")).cast("double")).otherwise(F.col(value)).alias("_d"))
    sizes = rows.groupBy(*by).agg(F.count("_d").alias("groups"), F.count_if(F.col("_d").isNull()).alias("unpaired"),
                                  F.avg("_d").alias("_mean"))
    drawn = rows.filter("_d is not null").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_g", F.col("_i").cast("string"))), 1, 7), 16, 10)
    weighted = drawn.withColumn("_u", draw.cast("long")).withColumn("_w", reduce(
        lambda a, b: a + b, [(F.col("_u") >= step).cast("int") for step in POISSON_STEPS]))
    means = weighted.groupBy(*by, "_i").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("_d")), F.sum("_w")).alias("_m"))
    bounds = means.groupBy(*by).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))  # samples values
    return sizes.join(bounds, by, "left").select(
        *keys, (100 * F.col("_mean")).alias("difference_pp"), (100 * F.col("_q")[0]).alias("low_pp"),
        (100 * F.col("_q")[1]).alias("high_pp"), "groups", "unpaired")


def rerank_gate(means: DataFrame, median_seconds: float, maximum_seconds: float) -> DataFrame:
    """Reranking is enabled only when quality improves and its median latency is affordable."""
    from citefold.operators.metrics import mode_gate

    gate = mode_gate(means, "mode", "on", "off")
    return gate.select("*", (F.col("accepted") & F.lit(median_seconds <= maximum_seconds)).alias("enabled"))


def seeded_order(df: DataFrame, keys: list[str], seed: int, name: str = "position") -> DataFrame:
    """Reproducible shuffled schedule: order by the SHA-256 of seed and keys, ties by key."""
    from citefold.operators.scale import dense_row_ids

    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    hashed = df.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256))
    return dense_row_ids(hashed, ["_h", *keys], name).drop("_h")
