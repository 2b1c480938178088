"""Scoring of a detection evaluation: trials, controls, traps, scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_label(verdict: Column, alert: Column, ladder_step: Column, overall: Column) -> Column:
    return F.coalesce(verdict, alert, F.concat(F.lit("ladder:"), ladder_step), F.concat(F.lit("ladder_overall:"), overall))


def scored(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trials that ran, and per class those that failed to run with the first error."""
    ran = results.filter(~F.col("failed"))
    skipped = (results.filter("failed").groupBy("class")
               .agg(F.count(F.lit(1)).alias("trials"), F.concat(F.lit("injection failed: "), F.min_by("error", "trial")).alias("reason")))
    return ran, skipped


def evaluate(observations: DataFrame, classes: DataFrame) -> DataFrame:
    """Whether every assertion of a trial's class holds, and the label observed.

    observations: class, trial, verdict, alerts, ladder (map step to ok), overall, sealed.
    classes: class, exp_verdict, exp_alert, exp_step, exp_ok, exp_overall, exp_sealed (null = not asserted).
    """
    df = observations.join(classes, "class")
    f = F.lit(False)
    asserted = [
        (F.col("exp_verdict"), F.col("verdict") == F.col("exp_verdict")),
        (F.col("exp_alert"), F.array_contains("alerts", F.col("exp_alert"))),
        (F.col("exp_step"), F.element_at("ladder", F.col("exp_step")) == F.col("exp_ok")),
        (F.col("exp_overall"), F.col("overall") == F.col("exp_overall")),
        (F.col("exp_sealed"), F.col("sealed")),
    ]
    checks = F.array_compact(F.array(*[F.when(want.isNotNull(), F.coalesce(ok, f)) for want, ok in asserted]))
    detected = (F.size(checks) > 0) & F.forall(checks, lambda c: c)
    label = expected_label(F.col("exp_verdict"), F.col("exp_alert"), F.col("exp_step"), F.col("exp_overall"))
    return (df.withColumn("detected", detected)
            .withColumn("observed", F.when(F.col("detected"), label).otherwise(F.coalesce("verdict", F.get("alerts", F.lit(0)))))
            .select(*observations.columns, "detected", "observed"))


def confusion(results: DataFrame) -> DataFrame:
    return (results.groupBy("class", F.coalesce("observed", F.lit("NONE")).alias("observed"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class(results: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Trials, detections, rate and nearest-rank latency percentiles per class."""
    lat = "CASE WHEN detected THEN latency_ms END"
    df = results.groupBy("class").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("detected").alias("detected"),
        percentile(lat, 0.5).alias("p50_ms"), percentile(lat, 0.95).alias("p95_ms"))
    df = df.withColumn("rate", F.col("detected") / F.col("trials"))
    if planned is not None:
        df = df.join(planned, "class", "left").withColumn("planned", F.coalesce("planned", "trials"))
    return df


def percentile(value: str, p: float) -> Column:
    """Nearest-rank percentile of an expression. Keeps one counter per distinct value (whole ms)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("bigint")


def alert_buckets(alerts: DataFrame, classes: DataFrame) -> DataFrame:
    """Alerts on injected blocks (class, trial, rule): expected, side (allowed) or unexpected, counted per class and rule."""
    df = alerts.join(classes.select("class", "exp_alert", "allowed"), "class")
    bucket = (F.when(F.col("rule") == F.col("exp_alert"), "expected")
              .when(F.array_contains("allowed", F.col("rule")), "side").otherwise("unexpected"))
    return df.groupBy("class", "rule", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def controls(rows: DataFrame, verdict: str = "PRODUCER_SIGNED") -> DataFrame:
    """Pass or fail per control trial, with the first reason it failed."""
    why = (F.when(~F.col("status").eqNullSafe(F.lit("ok")), F.concat(F.lit("not run: "), F.coalesce("error", "status", F.lit("no status"))))
           .when(F.col("block_id").isNull(), "no block id").when(~F.coalesce("indexed", F.lit(False)), "block never indexed")
           .when(~F.col("verdict").eqNullSafe(F.lit(verdict)), F.concat(F.lit("verdict "), F.coalesce("verdict", F.lit("None")), F.lit(f", not {verdict}")))
           .when(F.size("alerts") > 0, F.concat(F.lit("alerts: "), F.array_join("alerts", ", "))))
    return rows.withColumn("why", why).withColumn("passed", F.col("why").isNull())


def trap(sent: DataFrame, attributed: DataFrame, allowed: list[str], min_messages: int, min_s: float) -> DataFrame:
    """False positives on genuine traffic and whether it met its profile: one row."""
    a = attributed.agg(F.count_distinct("id").alias("alerts"))
    m = sent.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("verdict").isNull()).alias("not_indexed"),
                 F.count_if(F.col("verdict").isNotNull() & ~F.col("verdict").isin(*allowed)).alias("bad_verdicts"),
                 ((F.max("at_ms") - F.min("at_ms")) / 1000).alias("duration_s"))
    df = m.join(F.broadcast(a))  # one row each
    return df.select("messages", "duration_s", "not_indexed", "alerts", (F.col("alerts") + F.col("bad_verdicts")).alias("false_positives"),
                     ((F.col("messages") >= min_messages) & (F.col("duration_s") >= min_s) & (F.col("not_indexed") == 0)).alias("meets_profile"))


def trap_alerts(sent: DataFrame, elements: DataFrame, alerts: DataFrame, start_ms: int, window_end_ms: int) -> DataFrame:
    """Alerts on the sent blocks, or on the trap's elements since its start; each once, up to the window's end."""
    inside = alerts.filter(F.col("at_ms") <= window_end_ms)
    on_block = inside.join(sent.select("block_id").distinct(), "block_id", "left_semi")
    on_ie = inside.filter(F.col("at_ms") >= start_ms).join(elements.select("ie_id").distinct(), "ie_id", "left_semi")
    return on_block.select(*alerts.columns).union(on_ie.select(*alerts.columns)).dropDuplicates(["id"])


def late_alerts(trials: DataFrame, alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """Alerts on a trial's block or element not seen while it ran, per class and rule.

    trials: class, trial, block_id, ie_id (null unless the element is the trial's own), start_ms; seen: trial, id."""
    a = alerts.select("id", "rule", "block_id", "ie_id", "at_ms")
    by_block = trials.filter("block_id IS NOT NULL").select("class", "trial", "block_id").join(a.drop("ie_id"), "block_id").select("class", "trial", "id", "rule")
    by_ie = (trials.filter("ie_id IS NOT NULL").select("class", "trial", "ie_id", "start_ms").join(a.drop("block_id"), "ie_id")
             .filter("at_ms >= start_ms").select("class", "trial", "id", "rule"))
    new = by_block.union(by_ie).distinct().join(seen.select("trial", "id"), ["trial", "id"], "left_anti")
    return new.groupBy("class", "rule").agg(F.count(F.lit(1)).alias("n"))


def detections(trials: DataFrame, alerts: DataFrame) -> DataFrame:
    """Latency per detected trial: first matching alert, else the first poll that saw it, from the injection.

    trials: trial, exp_alert, block_id, injected_ms, polled_ms."""
    first = (trials.select("trial", "block_id", F.col("exp_alert").alias("rule"))
             .join(alerts.select("block_id", "rule", "at_ms"), ["block_id", "rule"]).groupBy("trial").agg(F.min("at_ms").alias("alert_ms")))
    df = trials.join(first, "trial", "left")
    return df.select("trial", F.greatest(F.lit(0).cast("bigint"), F.coalesce("alert_ms", "polled_ms") - F.col("injected_ms")).alias("latency_ms"),
                     F.when(F.col("alert_ms").isNotNull(), "alert").otherwise("poll").alias("source"))


def parity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per trial whether two verifiers agree on every step (rows trial, step, ok; the overall is a step)."""
    df = first.select("trial", "step", F.col("ok").alias("_a")).join(second.select("trial", "step", F.col("ok").alias("_b")), ["trial", "step"], "full_outer")
    return df.groupBy("trial").agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("agree"))


def scorecard(results: DataFrame, planned: DataFrame, unexpected: DataFrame, control_rows: DataFrame,
              trap_row: DataFrame, skipped: DataFrame) -> DataFrame:
    """The totals and the headline: one row."""
    lat = "CASE WHEN detected THEN latency_ms END"
    r = results.agg(F.count_if("detected").alias("detected"), F.count(F.lit(1)).alias("attacks"),
                    percentile(lat, 0.5).alias("p50_ms"), percentile(lat, 0.95).alias("p95_ms"))
    p = planned.agg(F.sum("planned").alias("planned"))
    u = unexpected.filter("bucket = 'unexpected'").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("unexpected"))
    c = controls(control_rows).agg(F.count(F.lit(1)).alias("controls"), F.count_if("passed").alias("controls_passed"))
    t = trap_row.select("messages", "false_positives", "not_indexed")
    s = skipped.agg(F.coalesce(F.sum("trials"), F.lit(0)).cast("bigint").alias("not_run"),
                    F.array_join(F.array_sort(F.collect_set("class")), ", ").alias("not_run_classes"))
    df = r
    for part in (p, u, c, t, s):
        df = df.join(F.broadcast(part))  # one row each
    valid = (F.col("controls") > 0) & (F.col("controls") == F.col("controls_passed"))
    prefix = (F.when(valid, "").when(F.col("controls") == 0, "INVALID RUN (control C01 not run): ")
              .otherwise("INVALID RUN (control C01 failed): "))
    n = lambda c: F.col(c).cast("string")
    text = F.concat(prefix, F.lit("detected "), n("detected"), F.lit("/"), n("attacks"), F.lit(" attacks ("), n("detected"), F.lit("/"),
                    n("planned"), F.lit(" planned), "), n("unexpected"), F.lit(" unexpected alerts, "), n("false_positives"), F.lit("/"),
                    n("messages"), F.lit(" false positives"),
                    F.when(F.col("not_indexed") > 0, F.concat(F.lit(", "), n("not_indexed"), F.lit(" trap messages not indexed"))).otherwise(""),
                    F.when(F.col("not_run") > 0, F.concat(F.lit(" ("), n("not_run"), F.lit(" planned trials not run: "), F.col("not_run_classes"), F.lit(")"))).otherwise(""))
    rate = F.when(F.col("attacks") > 0, F.col("detected") / F.col("attacks")).otherwise(0.0)
    return df.withColumn("valid", valid).withColumn("rate", rate).withColumn("headline", text)
