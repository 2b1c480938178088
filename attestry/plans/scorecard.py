"""The scorecard of a detection evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring


def build(results: DataFrame, classes: DataFrame, alerts: DataFrame, control_rows: DataFrame, trap_row: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per class, confusion, summary). classes: class, exp_alert, allowed, planned; alerts: class, trial, rule."""
    ran, skipped = scoring.scored(results)
    buckets = scoring.alert_buckets(alerts, classes)
    summary = scoring.scorecard(ran, classes.select("class", "planned"), buckets, control_rows, trap_row, skipped)
    return scoring.per_class(ran, classes.select("class", "planned")), scoring.confusion(ran), summary


def summary_from_ledger(t) -> DataFrame:
    from ..catalog import aggregates as A
    seen = t.trials.filter("extra_alert IS NOT NULL").select("class", "trial", F.col("extra_alert").alias("rule"))
    control_rows = t.messages.selectExpr(*A.CONTROL_COLS, "CASE WHEN n % 23 = 0 THEN array('SHADOW') ELSE cast(array() AS array<string>) END AS alerts")
    return build(t.trials, A.answer_key(t), seen, control_rows, A.trap_row(t))[2]
