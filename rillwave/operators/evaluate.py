"""Lead times and false alarms against labelled event times, as forward as-of joins.

Only the first alert of a look-back and the first event after an alert matter, so nothing pairs
events with all alerts near them: times are negated and the backward as-of join finds the one
row that counts, in time buckets, however many rows a session has. ``alert_profile`` wants all of them
and joins the look-backs with the alerts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .asof import asof_backward
from .intervals import interval_join

LEVELS = ("EARLY_WARNING", "IMMINENT")


def _alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("level").isin(*LEVELS)).select("session_id", "level", F.col("t").alias("alert_t"))


def _first_after(left: DataFrame, begin: str, right: DataFrame, time: str, within: float) -> DataFrame:
    """Left rows plus ``ref``: the earliest right row at or after ``begin``, at most ``within`` seconds later."""
    probe = left.withColumn("_q", -F.col(begin))
    held = right.select("session_id", F.col(time), (-F.col(time)).alias("_n"))
    return asof_backward(probe, held, ["session_id"], "_q", "_n", within, width=max(3600.0, within)).drop("_q")


def lead_times(events: DataFrame, alerts: DataFrame, lookback_min: float = 15.0) -> DataFrame:
    """Per event: minutes from the earliest alert of each level within the look-back to the event."""
    back = lookback_min * 60.0
    out = events.select("session_id", F.col("t").alias("event_t")).withColumn("_from", F.col("event_t") - back)
    for level in LEVELS:
        mine = _alerts(alerts).where(F.col("level") == level)
        hit = F.when(F.col("ref.alert_t") <= F.col("event_t"), F.col("ref.alert_t"))
        out = (_first_after(out, "_from", mine, "alert_t", back + 1e-3)
               .withColumn(f"{level.lower()}_lead_min", F.bround((F.col("event_t") - hit) / 60.0, 2)).drop("ref"))
    return out.drop("_from").withColumn("event_min", F.bround(F.col("event_t") / 60.0, 2))


def false_alarms(events: DataFrame, alerts: DataFrame, horizon_min: float) -> DataFrame:
    """Alerts that no event follows within the horizon plus two minutes."""
    ev = events.select("session_id", F.col("t").alias("event_t"))
    return (_first_after(_alerts(alerts), "alert_t", ev, "event_t", (horizon_min + 2.0) * 60.0)
            .where("ref is null").drop("ref"))


def evaluation(events: DataFrame, alerts: DataFrame, horizon_min: float, lookback_min: float = 15.0) -> DataFrame:
    """Per session: alerts, false alarms and events detected at each level."""
    leads = (lead_times(events, alerts, lookback_min).groupBy("session_id")
             .agg(F.count("*").alias("n_events"), F.count("early_warning_lead_min").alias("detected_early"),
                  F.count("imminent_lead_min").alias("detected_imminent")))
    wrong = false_alarms(events, alerts, horizon_min).groupBy("session_id").agg(F.count("*").alias("false_alarms"))
    fired = _alerts(alerts).groupBy("session_id").agg(F.count("*").alias("n_alerts"))
    return (leads.join(fired, "session_id", "full").join(wrong, "session_id", "full")
            .na.fill(0, ["n_events", "detected_early", "detected_imminent", "n_alerts", "false_alarms"]))


def alert_profile(events: DataFrame, alerts: DataFrame, lookback_min: float = 15.0, levels: tuple[str, ...] = (*LEVELS, "CLINICAL_RISK")) -> DataFrame:
    """Per event and level: all alerts within the look-back, with the longest, shortest and mean lead in minutes.

    Levels without an alert give 0 and no lead; events that repeat count once.
    """
    own = events.select("session_id", F.col("t").alias("event_t")).distinct()
    spans = own.withColumn("_from", F.col("event_t") - lookback_min * 60.0)
    lead = (F.col("event_t") - F.col("alert_t")) / 60.0
    found = (interval_join(spans, alerts.select("session_id", "level", F.col("t").alias("alert_t")), "session_id", "_from", "event_t", "alert_t")
             .groupBy("session_id", "event_t", "level").agg(F.count("*").alias("n_alerts"), F.max(lead).alias("first_lead_min"),
                                                            F.min(lead).alias("last_lead_min"), F.avg(lead).alias("mean_lead_min")))
    every = own.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return every.join(found, ["session_id", "event_t", "level"], "left").na.fill(0, ["n_alerts"])
