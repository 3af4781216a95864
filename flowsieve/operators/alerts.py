"""Scores to alerts: severity, action, ids, rate limit, summaries.

Severity and action use the same cuts on confidence (>= 0.9, 0.8, 0.7).
The rate limiter keeps an alert attempt when at most ``cap`` attempts
(kept or not) fall in the trailing window ending at it, attempts at the
same instant counted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.operators.ordering import running_totals
from flowsieve.schema import SEVERITY_CUTS, SEVERITY_FLOOR

MICROS = 1_000_000
HALO_BUCKET_ROWS = 2_000_000   # rows of one (key, time bucket) that a task sorts in a window


def severity(conf: Column) -> Column:
    out = None
    for cut, sev, _ in SEVERITY_CUTS:
        out = F.when(conf >= cut, sev) if out is None else out.when(conf >= cut, sev)
    return out.otherwise(SEVERITY_FLOOR[0])


def recommended_action(conf: Column) -> Column:
    out = None
    for cut, _, act in SEVERITY_CUTS:
        out = F.when(conf >= cut, act) if out is None else out.when(conf >= cut, act)
    return out.otherwise(SEVERITY_FLOOR[1])


def flow_id(df_src="src_ip", sport="src_port", dst="dst_ip", dport="dst_port") -> Column:
    return F.concat(F.col(df_src), F.lit(":"), F.col(sport).cast("string"), F.lit("->"),
                    F.col(dst), F.lit(":"), F.col(dport).cast("string"))


def flow_hash_bucket(fid: Column) -> Column:
    """Stable 0..9999 bucket of a flow id: first 8 hex digits of md5, mod 10000."""
    return F.conv(F.substring(F.md5(fid), 1, 8), 16, 10).cast("bigint") % 10000


def epoch_seconds(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / MICROS).cast("bigint")


def score_flows(df: DataFrame, prob_col: str = "score", threshold: float = 0.7,
                ts_col: str = "flow_ts") -> DataFrame:
    """Prediction record per flow: id, label text, confidence, alert flag.

    A flow is malicious when its probability is strictly above the
    threshold; it raises an alert when also at or above the threshold.
    """
    p = F.col(prob_col)
    label = p > threshold
    return df.select("*", flow_id().alias("flow_id"),
                     F.when(label, "MALICIOUS").otherwise("BENIGN").alias("prediction"),
                     p.cast("double").alias("confidence"),
                     (label & (p >= threshold)).alias("alert"))


def make_alerts(scored: DataFrame, ts_col: str = "flow_ts", keep=("flow_seq",)) -> DataFrame:
    """Alert records for scored flows with ``alert`` set."""
    c = F.col("confidence")
    pct = F.format_string("%.2f%%", c * 100)
    return scored.where(F.col("alert")).select(
        *[F.col(k) for k in keep if k in scored.columns],
        F.concat(F.lit("IDS_"), epoch_seconds(F.col(ts_col)).cast("string"), F.lit("_"),
                 flow_hash_bucket(F.col("flow_id")).cast("string")).alias("alert_id"),
        F.col(ts_col).alias("timestamp"),
        severity(c).alias("severity"),
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "prediction",
        c.alias("confidence"),
        F.concat(F.lit("Malicious network activity detected with "), pct, F.lit(" confidence")
                 ).alias("description"),
        recommended_action(c).alias("recommended_action"))


def rate_limit(alerts: DataFrame, ts_col: str = "timestamp", cap: int = 100,
               window_seconds: int = 60, key_cols: list[str] | None = None,
               bucket_seconds: int | None = None, seq_col: str = "flow_seq",
               method: str = "auto") -> DataFrame:
    """Add ``window_count`` (attempts in the trailing window, itself and
    same-instant attempts included) and ``passed`` = window_count <= cap.

    ``method='auto'`` (default) counts the rows of each (key, time bucket) and
    takes ``halo`` unless one of them is too much for a task. Both give the same
    rows. ``method='prefix'`` never needs a key's timeline in one task:
    with C(x) = attempts of the key at or before time x, the count is
    C(t) - C(t - window). Two probe rows per attempt (at t and t - window,
    ordered after attempts at the same instant) are interleaved with the
    attempts in (key, time) order, and a distributed prefix count
    (``running_totals``) gives C at every probe; the difference within a key
    cancels the key's offset. ``seq_col`` must identify attempts uniquely.
    ``method='halo'`` evaluates a RANGE frame per (key, time bucket) with a
    one-window halo: cheaper, but one hot key-and-bucket is one task.
    """
    if method == "auto":
        bucket = F.floor(F.unix_micros(F.col(ts_col).cast("timestamp"))
                         / (max(bucket_seconds or 10 * window_seconds, window_seconds) * MICROS))
        most = (alerts.groupBy(*(key_cols or []), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
                .agg(F.max("n")).first()[0])
        method = "halo" if (most or 0) <= HALO_BUCKET_ROWS else "prefix"
    if method == "halo":
        return _rate_limit_halo(alerts, ts_col, cap, window_seconds, key_cols, bucket_seconds)
    keys = list(key_cols or [])
    win_us = window_seconds * MICROS
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    rid = F.col(seq_col)

    def part(time_col, kind, side, weight):
        return alerts.select(*keys, time_col.alias("_t"), F.lit(kind).alias("_kind"), rid.alias("_rid"),
                             F.lit(side).alias("_side"), F.lit(weight).cast("long").alias("_w"))

    events = part(t, 0, 0, 1)
    upper = part(t, 1, 1, 0)                       # C(t): attempts at or before t
    lower = part(t - F.lit(win_us), 1, 0, 0)       # C(t - W): attempts outside the window
    timeline = events.unionByName(upper).unionByName(lower)
    counted = running_totals(timeline, [*keys, "_t", "_kind", "_rid", "_side"], {"_c": F.col("_w")})
    probes = counted.where(F.col("_kind") == 1)
    per = probes.groupBy("_rid").agg(
        (F.max(F.when(F.col("_side") == 1, F.col("_c"))) - F.max(F.when(F.col("_side") == 0, F.col("_c"))))
        .alias("window_count"))
    out = alerts.join(per, rid == F.col("_rid")).drop("_rid")
    return out.withColumn("passed", F.col("window_count") <= cap)


def _rate_limit_halo(alerts: DataFrame, ts_col: str, cap: int, window_seconds: int,
                     key_cols: list[str] | None, bucket_seconds: int | None) -> DataFrame:
    """Limiter per (key, time bucket); the last window of each bucket is copied
    into the next. An attempt adds one at its time and takes it back a window
    later, so a running sum is the window's count: the cost does not grow with
    the attempts in a window, as that of a sliding frame does."""
    keys = list(key_cols or [])
    win_us = window_seconds * MICROS
    bucket_us = max(bucket_seconds or 10 * window_seconds, window_seconds) * MICROS
    ts_us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    staged = alerts.withColumn("_ts_us", ts_us).withColumn("_own", F.floor(F.col("_ts_us") / bucket_us).cast("long"))
    t, own = F.col("_ts_us"), F.col("_own")

    def mark(bucket, time, step, mine):
        return F.struct(bucket.alias("bucket"), time.alias("time"), F.lit(step).cast("long").alias("step"), F.lit(mine).alias("mine"))

    in_tail = t > (own + 1) * bucket_us - win_us
    marks = F.when(in_tail, F.array(mark(own, t, 1, True), mark(own + 1, t, 1, False), mark(own + 1, t + win_us, -1, False))).otherwise(
        F.array(mark(own, t, 1, True), mark(own, t + win_us, -1, False)))
    spread = staged.where(own.isNotNull()).withColumn("_mark", F.explode(marks))
    # of copies and withdrawals only key, place and step are needed
    payload = [F.col(f"`{c}`") if c in keys else F.when(F.col("_mark.mine"), F.col(f"`{c}`")).alias(c) for c in alerts.columns]
    spread = spread.select(*payload, F.col("_mark.bucket").alias("_bucket"), F.col("_mark.time").alias("_time"),
                           F.col("_mark.step").alias("_step"), F.col("_mark.mine").alias("_mine"))
    # a frame from the start up to the row's peers is one running sum
    w = Window.partitionBy(*keys, "_bucket").orderBy("_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = spread.withColumn("window_count", F.sum("_step").over(w))
    return (counted.where("_mine").withColumn("passed", F.col("window_count") <= cap)
            .drop("_bucket", "_time", "_step", "_mine"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def alerts_per_minute(alerts: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    return (alerts.groupBy(F.date_trunc("minute", F.col(ts_col)).alias("minute"))
            .agg(F.count(F.lit(1)).alias("n_alerts")))


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                      F.count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
                      F.count_if(F.col("severity") == "HIGH").alias("high_alerts"),
                      F.avg("confidence").alias("avg_confidence"))


def filter_alerts(alerts: DataFrame, severity_filter: str = "All", min_confidence: float = 0.0,
                  max_alerts: int = 50, order_cols=("timestamp", "flow_seq")) -> DataFrame:
    """Severity equality ('All' disables), confidence floor, first N by arrival."""
    out = alerts
    if severity_filter != "All":
        out = out.where(F.col("severity") == severity_filter)
    out = out.where(F.col("confidence") >= min_confidence)
    return out.orderBy(*order_cols).limit(max_alerts)


def recent_alerts(alerts: DataFrame, n: int = 10, order_cols=("timestamp", "flow_seq")) -> DataFrame:
    """The newest ``n`` alerts, newest first."""
    return alerts.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


def running_counters(scored: DataFrame, ts_col: str = "flow_ts", key: str = "flow_seq",
                     bucket_rows: int | None = None) -> DataFrame:
    """Cumulative pipeline counters after each flow in time order, with
    detection and alert rates in percent (denominators at least 1)."""
    mal = F.when(F.col("prediction") == "MALICIOUS", 1).otherwise(0).cast("long")
    sums = {"total_flows_processed": F.lit(1).cast("long"), "malicious_flows": mal,
            "alerts_generated": F.col("alert").cast("long")}
    out = running_totals(scored, [ts_col, key], sums, bucket_rows)
    tot = F.greatest(F.col("total_flows_processed"), F.lit(1))
    return out.select(
        "*",
        (F.col("total_flows_processed") - F.col("malicious_flows")).alias("benign_flows"),
        (F.lit(100.0) * F.col("malicious_flows") / tot).alias("detection_rate"),
        (F.lit(100.0) * F.col("alerts_generated") / tot).alias("alert_rate")).drop("_idx")


def pipeline_statistics(scored: DataFrame, ts_col: str = "flow_ts") -> DataFrame:
    """One-row counters over a scored table (batch form of the live counters)."""
    ts = F.unix_micros(F.col(ts_col).cast("timestamp"))
    agg = scored.agg(F.count(F.lit(1)).alias("total_flows_processed"),
                     F.count_if(F.col("prediction") == "BENIGN").alias("benign_flows"),
                     F.count_if(F.col("prediction") == "MALICIOUS").alias("malicious_flows"),
                     F.count_if(F.col("alert")).alias("alerts_generated"),
                     ((F.max(ts) - F.min(ts)) / F.lit(float(MICROS))).alias("uptime_seconds"))
    tot = F.greatest(F.col("total_flows_processed"), F.lit(1))
    return agg.select(
        "*",
        (F.col("total_flows_processed") / F.greatest(F.col("uptime_seconds"), F.lit(1.0))).alias("flows_per_second"),
        (F.lit(100.0) * F.col("malicious_flows") / tot).alias("detection_rate"),
        (F.lit(100.0) * F.col("alerts_generated") / tot).alias("alert_rate"))


def hourly_history(scored: DataFrame, ts_col: str = "flow_ts") -> DataFrame:
    """Counter snapshots at the end of each hour that has flows (the
    metrics-history table): cumulative counters and rates."""
    hourly = (scored.groupBy(F.date_trunc("hour", F.col(ts_col)).alias("hour"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(F.col("prediction") == "MALICIOUS").alias("m"),
                   F.count_if(F.col("alert")).alias("a")))
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)   # one row per hour
    cum = hourly.select(
        (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("timestamp"),
        F.sum("n").over(w).alias("total_flows_processed"),
        F.sum("m").over(w).alias("malicious_flows"),
        F.sum("a").over(w).alias("alerts_generated"))
    tot = F.greatest(F.col("total_flows_processed"), F.lit(1))
    return cum.select("*",
                      (F.col("total_flows_processed") - F.col("malicious_flows")).alias("benign_flows"),
                      (F.lit(100.0) * F.col("malicious_flows") / tot).alias("detection_rate"),
                      (F.lit(100.0) * F.col("alerts_generated") / tot).alias("alert_rate"))


def history_summary(history: DataFrame, start_date: str, end_date: str,
                    ts_col: str = "timestamp") -> DataFrame:
    """Date range [start, end] inclusive (half-open on timestamps for
    pruning): max cumulative counters and mean detection rate."""
    ts = F.col(ts_col)
    lo = F.to_timestamp(F.lit(start_date)).cast(history.schema[ts_col].dataType)
    hi = (F.to_timestamp(F.lit(end_date)) + F.expr("INTERVAL 1 DAY")).cast(history.schema[ts_col].dataType)
    sel = history.where((ts >= lo) & (ts < hi))
    return sel.agg(F.max("total_flows_processed").alias("total_flows"),
                   F.max("malicious_flows").alias("malicious_flows"),
                   F.avg("detection_rate").alias("avg_detection_rate"),
                   F.max("alerts_generated").alias("total_alerts"),
                   F.count(F.lit(1)).alias("n_snapshots"))


def value_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max]; the max falls in the last bin.

    The range is one aggregate row read first; binning is a grouped count.
    """
    lo, hi = df.agg(F.min(col), F.max(col)).collect()[0]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n long")
    width = (hi - lo) / bins
    x = F.col(col)
    b = (F.lit(0) if width == 0 else
         F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin",
                         (F.lit(lo) + F.col("bin") * F.lit(hi - lo) / bins).alias("bin_start"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(hi - lo) / bins).alias("bin_end"),
                         "n")
