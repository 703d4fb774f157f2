"""Run traces: an append-only event log, one row per event (run_id, seq, event, name, args, status, latency_ms, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diagnostics(events: DataFrame, first_tool: str) -> DataFrame:
    """Per run: steps, tool calls, empty results, repeated calls, time, and whether the first tool came before any other."""
    tool, model = F.col("event").isin("tool_end", "tool_error"), F.col("event") == "model_end"
    first = F.min(F.when(tool & (F.col("name") == first_tool), F.col("seq")))
    other = F.min(F.when(tool & (F.col("name") != first_tool), F.col("seq")))
    return events.groupBy("run_id").agg(
        F.count_if(model).alias("steps"),
        F.count_if(tool).alias("tool_calls"),
        F.count_if(tool & (F.col("status") == "empty")).alias("empty_results"),
        (F.count_if(tool) - F.countDistinct(F.when(tool, F.struct("name", "args")))).alias("repeated_calls"),
        F.coalesce(F.sum(F.when(model, F.col("latency_ms"))), F.lit(0)).alias("model_ms"),
        F.coalesce(F.sum(F.when(tool, F.col("latency_ms"))), F.lit(0)).alias("tools_ms"),
        F.when(other.isNotNull(), F.coalesce(first < other, F.lit(False))).alias("resolved_before_query"),
    )


def percentiles(rows: DataFrame, value: str, by: list[str], points: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles."""
    cols = [F.expr(f"percentile_disc({p / 100}) within group (order by {value})").alias(f"p{p}") for p in points]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *cols)


def warnings(diags: DataFrame, steps: int = 10, tokens: int = 80_000) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.col("repeated_calls") > 0, "repeated_tool_call"), F.when(F.col("steps") > steps, "many_steps"), F.when(~F.col("resolved_before_query"), "unresolved_query")))
    return diags.withColumn("warnings", codes)


def failure_stage(events: DataFrame) -> DataFrame:
    """Where a run without a good end failed: the last event's kind."""
    last = events.groupBy("run_id").agg(F.max_by(F.struct("event", "status"), "seq").alias("l"))
    stage = F.when((F.col("l.event") == "run_end") & (F.col("l.status") == "ok"), None).when(F.col("l.event") == "tool_error", "tool").when(F.col("l.event") == "model_end", "model").otherwise("finalise")
    return last.select("run_id", stage.alias("failure_stage"))


def replay(before: DataFrame, after: DataFrame) -> DataFrame:
    """Calls of two runs with the same key: does the result have the same hash?"""
    h = lambda df, n: df.select("call", F.sha2(F.col("result").cast("string"), 256).alias(n))
    rows = h(before, "_b").join(h(after, "_a"), "call", "full_outer")
    return rows.select("call", F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(F.col("_a") == F.col("_b"), "match").otherwise("differs").alias("state"))


def result_status(result: str = "result"):
    """ok, empty or error of a tool's JSON result."""
    c = F.col(result)
    return F.when(F.get_json_object(c, "$.error").isNotNull(), "error").when((F.get_json_object(c, "$.total") == "0") | c.isin("[]", "{}", "") | c.isNull(), "empty").otherwise("ok")


def mentioned_ids(events: DataFrame, pattern: str = r"([a-z]+:[A-Za-z0-9_]+)") -> DataFrame:
    """(run_id, id): ids that tool results hold."""
    return events.filter(F.col("event") == "tool_end").select("run_id", F.explode(F.regexp_extract_all("result", F.lit(pattern), 1)).alias("id")).distinct()


def finalise(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claimed ids (run_id, id) are kept where the run's evidence has them, else dropped with a reason."""
    e = evidence.select("run_id", "id", F.lit(True).alias("_seen")).distinct()
    rows = claims.join(e, ["run_id", "id"], "left")
    return rows.select("run_id", "id", F.col("_seen").isNotNull().alias("kept"), F.when(F.col("_seen").isNull(), "not in evidence").alias("reason"))
