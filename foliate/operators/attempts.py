"""Attempt chains, retry, section outputs and their batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.text import first_of
from foliate.operators.validate import verdict


def generate(
    inputs: DataFrame,
    text: Column | None = None,
    responses: DataFrame | None = None,
    failing: Column | None = None,
    on: Sequence[str] = ("template_version_id", "section_id"),
) -> DataFrame:
    """Text for each input: a column, a response table joined on ``on``, or a fixed sentence.

    ``text`` may be any expression, also an iterator ``pandas_udf`` that calls a model. ``failing``
    marks inputs whose call fails. Section ids count from 1 inside each version, so a table of responses names both; of
    several responses to one input the first text in order counts.
    """
    default = F.concat(F.lit("Deterministic content for section "), F.col("section_id").cast("string"))
    rows = inputs
    if responses is not None:
        rows = rows.join(responses.groupBy(*on).agg(F.min("text").alias("_response")), list(on), "left")
        default = F.coalesce("_response", F.lit("Generated content for section."))
    bad = F.lit(False) if failing is None else F.coalesce(failing, F.lit(False))
    rows = rows.withColumns({
        "llm_ok": ~bad,
        "raw_output": F.when(bad, F.lit("")).otherwise(default if text is None else text),
        "llm_error": F.when(bad, F.concat(F.lit("Simulated LLM failure for section "), F.col("section_id").cast("string"))),
    })
    return rows.drop("_response") if responses is not None else rows


def retry_eligibility(failure_type: Column, attempt: Column, max_retries: int = K.MAX_RETRIES) -> Column:
    return first_of([
        (attempt >= max_retries, "EXHAUSTED"),
        (failure_type.isin(*K.RETRY_ELIGIBLE), "ELIGIBLE"),
    ], F.lit("NOT_ELIGIBLE"))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2), attempt), F.lit(K.MAX_BACKOFF_SECONDS)).cast("int")


def judge(attempts: DataFrame, max_retries: int = K.MAX_RETRIES, **limits) -> DataFrame:
    """Each attempt with its verdict, code, and whether the chain ends there.

    A chain ends at the first valid attempt, at the first failure that may not be retried, and at
    attempt ``max_retries``. Of several codes the first in code order counts.
    """
    rows = verdict(attempts, "raw_output", **limits)
    ok, n = F.col("llm_ok"), F.col("attempt_no")
    valid = ok & F.col("is_valid")
    code = first_of([
        (~ok, "LLM_INVOCATION_FAILED"),
        (~valid, F.coalesce(F.get("error_codes", F.lit(0)), "failure_type")),
    ])
    message = first_of([
        (~ok, F.coalesce("llm_error", F.lit("LLM invocation failed")) if "llm_error" in attempts.columns else F.lit("LLM invocation failed")),
        (~valid, F.col("rejection_reason")),
    ])
    rows = rows.withColumns({
        "attempt_valid": valid,
        "attempt_code": code,
        "attempt_message": message,
        "attempt_failure": first_of([(~ok, K.GENERATION_FAILURE), (~valid, F.col("failure_type"))]),
    })
    again = (~ok | F.col("is_retryable")) & ~F.col("attempt_code").isin(*K.NON_RETRYABLE_CODES) & (n < max_retries)
    return rows.withColumn("is_terminal", valid | ~F.coalesce(again, F.lit(False)))


def outcomes(judged: DataFrame, *key: str, max_retries: int = K.MAX_RETRIES) -> DataFrame:
    """One output row per chain. A single aggregation with partial results: no window, no hot task.

    Only attempts 0 … ``max_retries`` - 1 can enter the history, so what is gathered is bounded.
    """
    n = F.col("attempt_no")
    row = F.struct(
        "attempt_no", "attempt_valid", "llm_ok", "attempt_code", "attempt_message", "attempt_failure",
        "validated_content", F.col("content_hash").alias("hash"), F.length("validated_content").alias("length"),
    )
    entry = F.struct(
        n.alias("attempt"),
        F.col("attempt_code").alias("error_code"),
        F.col("attempt_message").alias("error_message"),
    )
    stop = F.when(F.col("is_terminal"), n)
    folded = judged.groupBy(*key).agg(
        F.min_by(row, stop).alias("_stop"),
        F.max_by(row, n).alias("_last"),
        F.array_sort(F.collect_list(F.when(~F.col("is_terminal") & (n < max_retries), entry))).alias("_history"),
    )
    s = F.coalesce("_stop", "_last")
    rows = folded.withColumns({"_s": s, "_done": F.col("_stop").isNotNull()})
    s, done = F.col("_s"), F.col("_done")
    valid = done & s["attempt_valid"]
    exhausted = done & ~s["llm_ok"] & (s["attempt_no"] >= max_retries)
    history = F.filter("_history", lambda e: ~done | (e["attempt"] < s["attempt_no"]))
    return rows.select(
        *key,
        first_of([(valid, "VALIDATED"), (done, "FAILED")], F.lit("RETRYING")).alias("status"),
        F.when(valid, s["validated_content"]).alias("generated_content"),
        F.when(valid, s["hash"]).alias("content_hash"),
        F.coalesce(F.when(valid, s["length"]), F.lit(0)).alias("content_length"),
        first_of([(valid, F.lit(None).cast("string")), (exhausted, F.lit("RETRY_EXHAUSTED"))], s["attempt_code"]).alias("error_code"),
        first_of([
            (valid, F.lit(None).cast("string")),
            (exhausted, F.concat(F.lit("Retry exhausted after "), (s["attempt_no"] + 1).cast("string"), F.lit(" attempts: "), s["attempt_message"])),
        ], s["attempt_message"]).alias("error_message"),
        first_of([(valid, F.lit(None).cast("string")), (exhausted, F.lit(K.RETRY_EXHAUSTION))], s["attempt_failure"]).alias("failure_category"),
        (F.when(done, s["attempt_no"]).otherwise(s["attempt_no"] + 1)).cast("bigint").alias("retry_count"),
        F.lit(max_retries).alias("max_retries"),
        valid.alias("is_validated"),
        done.alias("is_immutable"),
        history.alias("retry_history"),
        F.when(F.size(history) > 0, F.element_at(history, -1)).alias("last_attempt"),
    )


def with_missing_inputs(outputs: DataFrame, inputs: DataFrame, *key: str) -> DataFrame:
    """Outputs whose input does not exist fail with MISSING_INPUT; the others are unaffected."""
    known = inputs.select(*key).distinct().withColumn("_known", F.lit(True))
    rows = outputs.join(known, list(key), "left")
    missing = F.col("_known").isNull()
    return rows.withColumns({
        "status": F.when(missing, "FAILED").otherwise(F.col("status")),
        "error_code": F.when(missing, "MISSING_INPUT").otherwise(F.col("error_code")),
        "error_message": F.when(missing, "Generation input not found").otherwise(F.col("error_message")),
        "generated_content": F.when(~missing, F.col("generated_content")),
        "is_validated": ~missing & F.col("is_validated"),
        "is_immutable": missing | F.col("is_immutable"),
    }).drop("_known")


def unexpected_errors(outputs: DataFrame, error: Column) -> DataFrame:
    """Outputs whose processing raised ``error`` (not NULL) fail with UNEXPECTED_ERROR."""
    bad = error.isNotNull()
    return outputs.withColumns({
        "error_message": F.when(bad, error).otherwise(F.col("error_message")),
        "error_code": F.when(bad, "UNEXPECTED_ERROR").otherwise(F.col("error_code")),
        "failure_category": F.when(bad, K.UNEXPECTED_ERROR).otherwise(F.col("failure_category")),
        "status": F.when(bad, "FAILED").otherwise(F.col("status")),
    })


def flags(outputs: DataFrame) -> DataFrame:
    """is_successful, is_failed, is_retry_exhausted, can_retry, is_ready_for_assembly."""
    has = F.coalesce("generated_content", F.lit("")) != ""
    exhausted = F.col("retry_count") >= F.col("max_retries")
    return outputs.withColumns({
        "is_successful": F.col("status").isin("COMPLETED", "VALIDATED") & has,
        "is_failed": F.col("status") == "FAILED",
        "is_retry_exhausted": exhausted,
        "can_retry": ~F.col("is_immutable") & ~exhausted & F.coalesce(F.col("failure_category").isin(*K.RETRY_ELIGIBLE), F.lit(False)),
        "is_ready_for_assembly": F.col("is_validated") & F.col("is_immutable") & has & (F.col("status") == "VALIDATED"),
    })


def batch_progress(outputs: DataFrame, *batch: str) -> DataFrame:
    """Counts per batch; the batch is final once completed and failed cover all its sections."""
    rows = outputs.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("total_sections"),
        F.count_if(F.col("status").isin("COMPLETED", "VALIDATED")).alias("completed_sections"),
        F.count_if(F.col("status") == "FAILED").alias("failed_sections"),
    )
    final = F.col("completed_sections") + F.col("failed_sections") >= F.col("total_sections")
    return rows.withColumns({
        "status": F.when(final, "COMPLETED").otherwise("IN_PROGRESS"),
        "is_immutable": final,
    })


def status_counts(outputs: DataFrame, *batch: str) -> DataFrame:
    """Total and one zero-filled column per status."""
    return outputs.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in K.OUTPUT_STATUSES],
    )


def readiness(outputs: DataFrame, *batch: str) -> DataFrame:
    """A batch is ready for assembly when it is final and every output is ready."""
    rows = flags(outputs)
    final = batch_progress(rows, *batch).select(*batch, "is_immutable")
    return rows.groupBy(*batch).agg(
        F.every("is_ready_for_assembly").alias("_all"), F.count_if("is_ready_for_assembly").alias("ready_outputs")
    ).join(final, list(batch)).select(*batch, "ready_outputs", (F.col("_all") & F.col("is_immutable")).alias("is_ready"))


def new_output_batches(input_batches: DataFrame, output_batches: DataFrame, key: str = "batch_key") -> DataFrame:
    """Input batches that may start: validated, immutable, without an output batch."""
    usable = input_batches.filter((F.col("status") == "VALIDATED") & F.col("is_immutable"))
    return usable.join(output_batches.select(key), key, "left_anti")


def duplicate_output_batches(input_batches: DataFrame, output_batches: DataFrame, key: str = "batch_key") -> DataFrame:
    return input_batches.join(output_batches.select(key), key, "left_semi")


def reset_for_retry(outputs: DataFrame) -> DataFrame:
    """Open outputs go back to IN_PROGRESS without content and errors; final ones stay."""
    open_ = ~F.col("is_immutable")
    cleared = {c: F.when(~open_, F.col(c)) for c in ("generated_content", "content_hash", "error_message", "error_code")}
    return outputs.withColumns({
        **cleared,
        "status": F.when(open_, "IN_PROGRESS").otherwise(F.col("status")),
        "content_length": F.when(open_, 0).otherwise(F.col("content_length")),
        "is_validated": ~open_ & F.col("is_validated"),
    })


def by_failure(outputs: DataFrame, category: str) -> DataFrame:
    return outputs.filter(F.col("failure_category") == category)


def retrying(outputs: DataFrame) -> DataFrame:
    return outputs.filter((F.col("status") == "RETRYING") & ~F.col("is_immutable"))


def validated(outputs: DataFrame) -> DataFrame:
    return outputs.filter(F.col("is_validated") & F.col("is_immutable"))
