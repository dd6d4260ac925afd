"""Operational aggregates (the dashboard panels) and change-feed logic as DataFrame queries.

Metrics are aggregates of event tables: an ``outcomes`` log (retailer, outcome, newest, at) and a
``request_log`` (route, latency, hit, at). Rates are tumbling-window counts divided by the window
length; quantiles are exact per window, by counting, and the exponential-bucket histogram is
kept as cumulative counts with the bucket-interpolated quantile next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelake.functions.joins import broadcast_if_small

# The request-latency histogram buckets (seconds), 0.002 · 2^k for k = 0..12.
LATENCY_BUCKETS = [0.002 * 2 ** k for k in range(13)]


def window_start(ts: str, length: str) -> Column:
    return F.window(ts, length).start


def rate_by(df: DataFrame, ts: str, length_sec: int, keys: list[str],
            value: Column | None = None) -> DataFrame:
    """Per tumbling window and key: count (or sum of ``value``) per second."""
    v = F.count(F.lit(1)) if value is None else F.sum(value)
    return (df.groupBy(window_start(ts, f"{length_sec} seconds").alias("window_start"), *keys)
              .agg((v / F.lit(float(length_sec))).alias("per_sec")))


def freshness(outcomes: DataFrame, retailers: DataFrame, now, accepted: Column) -> DataFrame:
    """Seconds since the newest accepted item per retailer; silent retailers stay listed
    (left join from the retailer dimension) with NULL newest."""
    newest = (outcomes.filter(accepted).groupBy("retailer_id")
                      .agg(F.max("newest").alias("newest")))
    r = retailers.select(F.col("id").alias("retailer_id"), "slug")
    now_us = F.unix_micros(F.lit(now).cast("timestamp"))
    age = (now_us - F.unix_micros(F.col("newest").cast("timestamp"))) / 1e6
    return (r.join(newest, "retailer_id", "left")
             .select("slug", "newest", age.alias("freshness_sec")))


#: Bins to the octave of the first pass over latencies.
BINS_PER_OCTAVE = 64


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group without holding a group: a histogram by the
    logarithm (a sum per bin, pre-reduced per task) shows which bins hold the ranks wanted, and of
    these alone the distinct values are counted and ranked. Columns q0, q1, ...; null values are left
    out, a group of nulls has null quantiles."""
    v = F.col(value)
    bin_ = F.when(v <= 0, F.lit(-(1 << 20))).otherwise(F.floor(F.log2(v) * BINS_PER_OCTAVE)).cast("int")
    binned = rows.select(*keys, v.cast("double").alias("v"), bin_.alias("bin"))
    bins = binned.groupBy(*keys, "bin").agg(F.count("v").alias("n"))
    group = Window.partitionBy(*keys)
    upto = bins.where("bin IS NOT NULL").withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (f(F.col("all") - 1, q)).cast("long").alias("rank"))
                      for i, q in enumerate(qs) for side, f in ((0, lambda n, q: F.floor(n * q)), (1, lambda n, q: F.ceil(n * q)))])
    wanted = (upto.withColumn("r", F.explode(ranks)).where((F.col("r.rank") < F.col("upto")) & (F.col("r.rank") >= F.col("upto") - F.col("n")))
              .select(*keys, "bin", "all", "r.*", (F.col("r.rank") - F.col("upto") + F.col("n")).alias("at")))
    held = binned.join(wanted.select(*keys, "bin").distinct(), [*keys, "bin"], "left_semi").groupBy(*keys, "bin", "v").agg(F.count("*").alias("n"))
    ordered = held.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("v")))
    found = wanted.join(ordered, [*keys, "bin"]).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - ordered["n"]))
    value_of = lambda i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("v")))
    out = []
    for i, q in enumerate(qs):
        place = (F.max("all") - 1) * F.lit(q)
        out.append((value_of(i, 0) + (value_of(i, 1) - value_of(i, 0)) * (place - F.floor(place))).alias(f"q{i}"))
    return bins.select(*keys).distinct().join(found.groupBy(*keys).agg(*out), keys, "left")


def latency_quantiles(log: DataFrame, length_sec: int, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated quantiles of latency (seconds) per route and window, reported to
    the nanosecond (9 decimals): engines interpolate in different arithmetic order."""
    rows = log.select(window_start("at", f"{length_sec} seconds").alias("window_start"), "route", "latency")
    return exact_quantiles(rows, ["window_start", "route"], "latency", qs).select(
        "window_start", "route", *[F.round(f"q{i}", 9).alias(f"p{int(round(q * 100))}") for i, q in enumerate(qs)])


def latency_histogram(log: DataFrame, bounds: list[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts per route (``le`` = upper bound, +Inf last)."""
    per_route = log.groupBy("route").agg(
        *[F.count_if(F.col("latency") <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("binf"))
    stack = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n"))
                      for i, b in enumerate(bounds)],
                    F.struct(F.lit(float("inf")).alias("le"), F.col("binf").alias("n")))
    return per_route.select("route", F.explode(stack).alias("x")).select("route", "x.le", "x.n")


def histogram_quantile(hist: DataFrame, q: float) -> DataFrame:
    """L14 from buckets: linear interpolation inside the bucket holding rank q·total; a rank in
    the +Inf bucket returns the highest finite bound."""
    g = hist.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("bk"))
    total = F.element_at("bk", -1)["n"]
    rank = total * q
    idx = F.array_position(F.transform("bk", lambda b: b["n"] >= rank), True)
    b = F.element_at("bk", idx.cast("int"))
    prev = F.when(idx > 1, F.element_at("bk", (idx - 1).cast("int"))).otherwise(
        F.struct(F.lit(0.0).alias("le"), F.lit(0).cast("long").alias("n")))
    finite_top = F.element_at("bk", -2)["le"]
    inside = prev["le"] + (b["le"] - prev["le"]) * (rank - prev["n"]) / (b["n"] - prev["n"])
    val = F.when(b["le"] == F.lit(float("inf")), finite_top).otherwise(inside)
    return g.select("route", F.lit(q).alias("q"), F.when(total > 0, val).alias("value"))


def hit_ratio(log: DataFrame, length_sec: int) -> DataFrame:
    """Share of hits per window (a conditional-ratio aggregate)."""
    return (log.groupBy(window_start("at", f"{length_sec} seconds").alias("window_start"))
               .agg((F.count_if("hit") / F.count(F.lit(1))).alias("hit_ratio")))


def change_feed_slice(log: DataFrame, since: int, limit: int) -> DataFrame:
    """A4 rows: per epoch the updates with since < seq ≤ since + limit (seq is dense per epoch)."""
    return log.filter((F.col("seq") > since) & (F.col("seq") <= since + limit))


def change_feed_status(log: DataFrame, since: int, limit: int, retained_from: int = 1) -> DataFrame:
    """A4/L5/L4 flags per epoch: rows returned, has_more, gone (cursor ahead of the head or
    older than the retained buffer)."""
    s = log.groupBy("epoch").agg(F.max("seq").alias("head"), F.min("seq").alias("first"))
    start = F.greatest(F.col("first"), F.lit(retained_from))
    gone = (F.lit(since) > F.col("head")) | (F.lit(since + 1) < start)
    n = F.greatest(F.least(F.col("head"), F.lit(since + limit)) - F.lit(since), F.lit(0))
    return s.select("epoch", "head", F.when(gone, 0).otherwise(n).cast("long").alias("rows"),
                    (~gone & (F.col("head") > since + limit)).alias("has_more"),
                    gone.alias("gone"))


def gaps(delivered: DataFrame) -> DataFrame:
    """L4 in batch: sequence gaps per epoch as (epoch, after_seq, next_seq).

    Gap starts are delivered rows whose successor is missing (an anti join on (epoch, seq + 1)).
    The row after a gap is the next delivered row, i.e. the delivered row whose rank within the
    epoch is one higher; ranks come from distributed dense ids (range partitions, no window over
    an epoch), so the pairing is an equi-join on (epoch, rank) and no task sees a whole epoch."""
    from pricelake.functions.ids import dense_index

    d = delivered.select("epoch", "seq")
    g = dense_index(d, ["epoch", "seq"], 0, "_g")
    first = g.groupBy("epoch").agg(F.min("_g").alias("_g0"))
    ranked = (g.join(broadcast_if_small(first, 100_000), "epoch")
               .select("epoch", "seq", (F.col("_g") - F.col("_g0")).alias("rank")))
    succ = d.select("epoch", (F.col("seq") - 1).alias("seq"))
    starts = ranked.join(succ, ["epoch", "seq"], "left_anti")
    nxt = ranked.select("epoch", (F.col("rank") - 1).alias("rank"), F.col("seq").alias("next_seq"))
    return (starts.join(nxt, ["epoch", "rank"], "inner")      # the last row of an epoch drops
                  .select("epoch", F.col("seq").alias("after_seq"), "next_seq"))


def cursor_positions(page_log: DataFrame) -> DataFrame:
    """The latest position per retailer over the processed-page log
    (retailer, arrival, phase, epoch, page, next_seq): the (phase, epoch, page, next_seq) of the
    last page processed. A hash aggregate with ``max_by``, partial per task."""
    last = F.max_by(F.struct("phase", "epoch", "page", "next_seq"), "arrival")
    return page_log.groupBy("retailer").agg(last.alias("p")).select("retailer", "p.*")


def epoch_resets(page_log: DataFrame) -> DataFrame:
    """L3 in batch: pages whose epoch differs from the previous page of the same retailer (the
    feed restarted, its sequence space reset: a resync is due). The page log has one row per
    page (hundreds of items each), so the per-retailer window runs over pages, not items."""
    from pyspark.sql import Window as W

    w = W.partitionBy("retailer").orderBy("arrival")
    prev = F.lag("epoch").over(w)
    return (page_log.select("retailer", "arrival", "epoch", prev.alias("prev_epoch"))
                    .filter(F.col("prev_epoch").isNotNull() & (F.col("epoch") != F.col("prev_epoch"))))
