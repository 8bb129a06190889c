"""Event-time rates and ratios over ticks, decisions, trades and ingest statuses.

Counts are combined per bucket before any shuffle, and whatever is ordered afterwards has one
row per minute, so its size follows the calendar and not the traffic. On a stream, pass frames
that carry a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINUTE = "1 minute"
# Alert limits.
ANOMALIES_PER_MINUTE, ANOMALY_HOLD_MIN = 50.0, 2
CONFIRMATION_FLOOR, CONFIRMATION_HOLD_MIN = 0.1, 15
BATCH_STATUSES = ["SUCCESS", "SKIPPED", "DUPLICATE", "CONFLICT", "REJECTED"]
FAILED_STATUSES = ["CONFLICT", "REJECTED"]


def _per_window(df: DataFrame, keys: list[str], aggregates: list[Column], width: str, slide: str | None = None):
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    grouped = df.groupBy(window.alias("_w"), *keys).agg(*aggregates)
    return grouped.withColumn("window_start", F.col("_w.start")).drop("_w")


def tick_rates(flagged: DataFrame) -> DataFrame:
    """Processed and deduplicated ticks per second, per minute window."""
    return _per_window(
        flagged, [],
        [(F.count_if(~F.col("is_duplicate")) / F.lit(60.0)).alias("processed_per_s"),
         (F.count_if("is_duplicate") / F.lit(60.0)).alias("deduplicated_per_s")],
        MINUTE,
    )


def anomaly_rates(decisions: DataFrame) -> DataFrame:
    """Anomalies per minute and score source."""
    return _per_window(decisions, ["source"], [F.count(F.lit(1)).alias("anomalies")], MINUTE)


def decision_rates(decisions: DataFrame) -> DataFrame:
    """Confirmed and rejected anomalies per minute."""
    return _per_window(
        decisions, [], [F.count_if("approved").alias("confirmed"), F.count_if(~F.col("approved")).alias("rejected")],
        MINUTE,
    )


def confirmation_rate(decisions: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Share of confirmed anomalies in a window sliding by a minute."""
    confirmed, total = F.count_if("approved"), F.count(F.lit(1))
    return _per_window(
        decisions, [], [confirmed.alias("confirmed"), total.alias("decided"),
                        F.try_divide(confirmed.cast("double"), total.cast("double")).alias("confirmation_rate")],
        width, MINUTE,
    )


def trade_rates(trades: DataFrame, minutes: int = 5) -> DataFrame:
    """Trades and profit in USD per minute over a window sliding by a minute."""
    per_minute = F.lit(float(minutes))
    return _per_window(
        trades, [],
        [(F.count(F.lit(1)) / per_minute).alias("trades_per_min"),
         (F.sum("estimated_profit_cents") / F.lit(100.0) / per_minute).alias("pnl_usd_per_min")],
        f"{minutes} minutes", MINUTE,
    )


def batch_outcomes(statuses: DataFrame) -> DataFrame:
    """Ingest statuses per minute, one column each, and the failed share."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in BATCH_STATUSES]
    failed = F.count_if(F.col("status").isin(FAILED_STATUSES))
    share = F.try_divide(failed.cast("double"), F.count(F.lit(1)).cast("double")).alias("failed_share")
    return _per_window(statuses, [], [*counts, share], MINUTE)


def held(series: DataFrame, condition: Column, minutes: int) -> DataFrame:
    """Minutes at which ``condition`` has been true in every one of the last ``minutes`` minutes.

    ``series`` has one row per minute (``window_start``); a missing minute breaks the run.
    Days are the window key with the hold period carried over, so no task orders more than a
    day and its lead-in.
    """
    minute = F.unix_seconds("window_start") / 60
    day = F.expr("_minute div 1440")
    marked = series.select(minute.cast("bigint").alias("_minute"), condition.alias("_hit"), "window_start")
    lead = F.when(F.col("_minute") % 1440 > 1440 - minutes, F.array(day, day + 1)).otherwise(F.array(day))
    spread = marked.withColumn("_own", day).withColumn("_day", F.explode(lead))
    frame = W.partitionBy("_day").orderBy("_minute").rangeBetween(-(minutes - 1), 0)
    hits = F.sum(F.when(F.coalesce("_hit", F.lit(False)), 1).otherwise(0)).over(frame)
    return spread.withColumn("firing", hits == minutes).filter("_day = _own").select("window_start", "firing")


def alerts(anomalies: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Firing alerts by name and minute.

    ``anomalies`` is ``anomaly_rates``, ``confirmations`` is ``confirmation_rate``.
    """
    total = anomalies.groupBy("window_start").agg(F.sum("anomalies").alias("anomalies"))
    high = held(total, F.col("anomalies") > ANOMALIES_PER_MINUTE, ANOMALY_HOLD_MIN)
    low = held(confirmations, F.col("confirmation_rate") < CONFIRMATION_FLOOR, CONFIRMATION_HOLD_MIN)
    named = [df.filter("firing").select("window_start", F.lit(name).alias("alert"))
             for name, df in (("high_anomaly_rate", high), ("low_confirmation_rate", low))]
    return named[0].unionByName(named[1])


def held_on_stream(counts: DataFrame, condition: Column, minutes: int, width: int) -> DataFrame:
    """The minutes at which ``held`` fires, for a stream in append mode.

    ``counts`` is a windowed aggregate with its ``window`` of ``width`` minutes, one row per minute. The hold is a second window over the
    ends of the first ones: it closes with its last minute, so an alert appears once and is never taken back, and state
    goes with the watermark. A missing minute breaks the run, as there.
    """
    hits = counts.filter(condition).groupBy(F.window(F.window_time("window"), f"{minutes} minutes", MINUTE).alias("_hold")).agg(
        F.count(F.lit(1)).alias("_hits"))
    start = F.col("_hold.end") - F.expr(f"INTERVAL {width} MINUTES")
    return hits.filter(F.col("_hits") == minutes).select(start.alias("window_start"))


def alerts_on_stream(decisions: DataFrame, width: int = 15) -> DataFrame:
    """``alerts`` from a stream of decisions with a watermark on ``event_time``: counts per minute and holds over them, as two
    windows one behind the other in each branch."""
    total = decisions.groupBy(F.window("event_time", MINUTE).alias("window")).agg(F.count(F.lit(1)).alias("anomalies"))
    rates = decisions.groupBy(F.window("event_time", f"{width} minutes", MINUTE).alias("window")).agg(
        F.count_if("approved").alias("confirmed"), F.count(F.lit(1)).alias("decided"))
    share = F.try_divide(F.col("confirmed").cast("double"), F.col("decided").cast("double"))
    high = held_on_stream(total, F.col("anomalies") > ANOMALIES_PER_MINUTE, ANOMALY_HOLD_MIN, 1)
    low = held_on_stream(rates, share < CONFIRMATION_FLOOR, CONFIRMATION_HOLD_MIN, width)
    return high.withColumn("alert", F.lit("high_anomaly_rate")).unionByName(low.withColumn("alert", F.lit("low_confirmation_rate")))


def activity_rates(flagged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ticks and decisions per minute from two streams in one query, each with its own watermark on ``event_time``; a
    minute closes when both have passed it."""
    kinds = [flagged.select("event_time", F.when(F.col("is_duplicate"), "deduplicated").otherwise("processed").alias("kind")),
             decisions.select("event_time", F.when(F.col("approved"), "confirmed").otherwise("rejected").alias("kind"))]
    counts = [(F.count_if(F.col("kind") == k) / F.lit(60.0)).alias(f"{k}_per_s") for k in ("processed", "deduplicated")]
    counts += [F.count_if(F.col("kind") == k).alias(k) for k in ("confirmed", "rejected")]
    return _per_window(kinds[0].unionByName(kinds[1]), [], counts, MINUTE)


def pnl_summary(trades: DataFrame) -> DataFrame:
    """Total estimated profit and number of trades."""
    return trades.agg(
        F.count(F.lit(1)).alias("trades"),
        F.coalesce(F.sum("estimated_profit_cents"), F.lit(0)).alias("estimated_profit_cents"),
    )


def pnl_running(trades: DataFrame) -> DataFrame:
    """Running totals by hour: hours within a day, on top of the days before."""
    hourly = (
        trades.groupBy(F.date_trunc("hour", "event_time").alias("hour"))
        .agg(F.count(F.lit(1)).alias("trades"), F.sum("estimated_profit_cents").alias("profit"))
        .withColumn("day", F.to_date("hour"))
    )
    daily = hourly.groupBy("day").agg(F.sum("trades").alias("_t"), F.sum("profit").alias("_p"))
    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    offsets = daily.select("day", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t"),
                           F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"))
    within = W.partitionBy("day").orderBy("hour")
    return hourly.join(offsets, "day").select(
        "hour", (F.col("_t") + F.sum("trades").over(within)).alias("running_trades"),
        (F.col("_p") + F.sum("profit").over(within)).alias("running_profit_cents"),
    )
