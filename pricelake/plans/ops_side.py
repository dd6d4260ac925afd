"""Operational queries: rates, freshness, quantiles, histogram, hit ratio, change feed, gaps,
coverage, registry upsert and feed positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelake.operators import ops
from pricelake.plans.oracle import with_views as V
from pricelake.plans.registry import query
from pricelake.sources import feed
from pricelake.sources import fixtures as fx
from pricelake.sources.tables import read_table

OUTCOMES_SQL = """WITH outcomes AS (
  SELECT CAST(user_id % 8 AS INTEGER) AS retailer_id, event_type AS outcome, ts AS newest, ts AS at,
         event_id, value FROM events)
"""
REQUESTS_SQL = """WITH request_log AS (
  SELECT event_type AS route, value / 1000.0 AS latency, ts AS at, event_type <> 'error' AS hit,
         event_id FROM events)
"""
CHANGE_SQL = """WITH change_log AS (
  SELECT CAST(user_id % 8 AS BIGINT) AS epoch,
         row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS seq,
         ts, event_id, event_type, value FROM events)
"""


@query("ops_item_rate", OUTCOMES_SQL + """
SELECT time_bucket(INTERVAL '60 seconds', "at") AS window_start, retailer_id, outcome,
       count(*) / 60.0 AS per_sec
FROM outcomes GROUP BY ALL""")
def q_ops_item_rate(spark, sf_dir):
    """Items per second by retailer and outcome, 1-minute windows."""
    return ops.rate_by(fx.outcomes(spark, sf_dir), "at", 60, ["retailer_id", "outcome"])


@query("ops_freshness", OUTCOMES_SQL.rstrip() + ",\n" + V("retailers")[len("WITH "):] + """
SELECT r.slug, n.newest,
       (epoch_us((SELECT max(ts) FROM events)) - epoch_us(n.newest)) / 1e6 AS freshness_sec
FROM retailers r LEFT JOIN (SELECT retailer_id, max(newest) AS newest FROM outcomes
                            WHERE outcome <> 'error' GROUP BY retailer_id) n
  ON n.retailer_id = r.id""")
def q_ops_freshness(spark, sf_dir):
    """Seconds since the newest accepted item per retailer, at the log's last instant."""
    now = read_table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return ops.freshness(fx.outcomes(spark, sf_dir), fx.retailers(spark, sf_dir), now,
                         F.col("outcome") != "error")


@query("ops_reject_rate", OUTCOMES_SQL + """
SELECT time_bucket(INTERVAL '300 seconds', "at") AS window_start, outcome, count(*) / 300.0 AS per_sec
FROM outcomes WHERE outcome NOT IN ('view', 'click') GROUP BY ALL""")
def q_ops_reject_rate(spark, sf_dir):
    """Rate by outcome over 5-minute windows, the accepted-like outcomes excluded."""
    o = fx.outcomes(spark, sf_dir).filter(~F.col("outcome").isin("view", "click"))
    return ops.rate_by(o, "at", 300, ["outcome"])


@query("ops_error_rate", OUTCOMES_SQL + """
SELECT time_bucket(INTERVAL '60 seconds', "at") AS window_start, retailer_id, count(*) / 60.0 AS per_sec
FROM outcomes WHERE outcome = 'error' GROUP BY ALL""")
def q_ops_error_rate(spark, sf_dir):
    """Errors per second by retailer, 1-minute windows."""
    o = fx.outcomes(spark, sf_dir).filter(F.col("outcome") == "error")
    return ops.rate_by(o, "at", 60, ["retailer_id"])


@query("ops_request_rate", REQUESTS_SQL + """
SELECT time_bucket(INTERVAL '60 seconds', "at") AS window_start, route, count(*) / 60.0 AS per_sec
FROM request_log GROUP BY ALL""")
def q_ops_request_rate(spark, sf_dir):
    """Requests per second by route, 1-minute windows."""
    return ops.rate_by(fx.request_log(spark, sf_dir), "at", 60, ["route"])


@query("ops_latency_quantiles", REQUESTS_SQL + """
SELECT time_bucket(INTERVAL '300 seconds', "at") AS window_start, route,
       round(quantile_cont(latency, 0.5), 9) AS p50, round(quantile_cont(latency, 0.95), 9) AS p95,
       round(quantile_cont(latency, 0.99), 9) AS p99
FROM request_log GROUP BY ALL""")
def q_ops_latency_quantiles(spark, sf_dir):
    """Exact p50/p95/p99 latency per route, 5-minute windows."""
    return ops.latency_quantiles(fx.request_log(spark, sf_dir), 300)


HIST_SQL = REQUESTS_SQL.rstrip() + """,
bounds AS (SELECT 0.002 * pow(2, k) AS le, k FROM range(13) t(k)
           UNION ALL SELECT 'inf'::DOUBLE, 13),
hist AS (SELECT r.route, b.le, b.k, count(l.latency) AS n
         FROM (SELECT DISTINCT route FROM request_log) r CROSS JOIN bounds b
         LEFT JOIN request_log l ON l.route = r.route AND l.latency <= b.le
         GROUP BY r.route, b.le, b.k)
"""


@query("ops_latency_histogram", HIST_SQL + "SELECT route, le, n FROM hist")
def q_ops_latency_histogram(spark, sf_dir):
    """Cumulative request-latency bucket counts per route (exponential bounds)."""
    return ops.latency_histogram(fx.request_log(spark, sf_dir))


@query("ops_histogram_quantiles", HIST_SQL + """,
tot AS (SELECT route, max(n) AS total FROM hist GROUP BY route),
qs AS (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q),
pick AS (
  SELECT t.route, qs.q, t.total, min(h.k) AS k FROM tot t CROSS JOIN qs
  JOIN hist h ON h.route = t.route AND h.n >= t.total * qs.q GROUP BY t.route, qs.q, t.total)
SELECT p.route, p.q,
       CASE WHEN p.total = 0 THEN NULL
            WHEN b.le = 'inf'::DOUBLE THEN (SELECT le FROM hist x WHERE x.route = p.route AND x.k = 12)
            ELSE coalesce(a.le, 0.0) + (b.le - coalesce(a.le, 0.0)) * (p.total * p.q - coalesce(a.n, 0))
                 / (b.n - coalesce(a.n, 0)) END AS value
FROM pick p JOIN hist b ON b.route = p.route AND b.k = p.k
LEFT JOIN hist a ON a.route = p.route AND a.k = p.k - 1""")
def q_ops_histogram_quantiles(spark, sf_dir):
    """L14 as the dashboard computes it: quantiles interpolated inside histogram buckets."""
    h = ops.latency_histogram(fx.request_log(spark, sf_dir))
    out = None
    for q in (0.5, 0.95, 0.99):
        part = ops.histogram_quantile(h, q)
        out = part if out is None else out.unionByName(part)
    return out


@query("ops_hit_ratio", REQUESTS_SQL + """
SELECT time_bucket(INTERVAL '300 seconds', "at") AS window_start,
       count(*) FILTER (WHERE hit) / count(*) AS hit_ratio
FROM request_log GROUP BY ALL""")
def q_ops_hit_ratio(spark, sf_dir):
    """Cache hit ratio per 5-minute window."""
    return ops.hit_ratio(fx.request_log(spark, sf_dir), 300)


@query("change_feed_slice", CHANGE_SQL + """
SELECT epoch, seq, event_id FROM change_log WHERE seq > 45 AND seq <= 145""")
def q_change_feed_slice(spark, sf_dir):
    """A4 rows: updates after cursor 45, 100 per epoch, in seq order within the epoch."""
    log = fx.change_log(spark, sf_dir)
    return ops.change_feed_slice(log, 45, 100).select("epoch", "seq", "event_id")


def _status_sql(since, limit):
    return CHANGE_SQL + f"""
SELECT epoch, max(seq) AS head,
       CAST(CASE WHEN {since} > max(seq) OR {since} + 1 < min(seq) THEN 0
            ELSE greatest(least(max(seq), {since} + {limit}) - {since}, 0) END AS BIGINT) AS rows,
       NOT ({since} > max(seq) OR {since} + 1 < min(seq)) AND max(seq) > {since} + {limit} AS has_more,
       ({since} > max(seq) OR {since} + 1 < min(seq)) AS gone
FROM change_log GROUP BY epoch"""


@query("change_feed_status", _status_sql(1240, 100))
def q_change_feed_status(spark, sf_dir):
    """A4 / L4 / L5 per epoch for cursor 1240, limit 100: rows, has_more, gone."""
    return ops.change_feed_status(fx.change_log(spark, sf_dir), 1240, 100)


@query("change_feed_gaps", CHANGE_SQL + """,
d AS (SELECT epoch, seq FROM change_log WHERE event_type <> 'error'),
nx AS (SELECT epoch, seq, lead(seq) OVER (PARTITION BY epoch ORDER BY seq) AS next_seq FROM d)
SELECT epoch, seq AS after_seq, next_seq FROM nx WHERE next_seq > seq + 1""")
def q_change_feed_gaps(spark, sf_dir):
    """L4: gaps in the delivered sequence when error updates are dropped."""
    log = fx.change_log(spark, sf_dir).filter(F.col("event_type") != "error")
    return ops.gaps(log)


# The carry rates of the reference's eight retailer profiles, in config order.
CARRY_RATES = [0.45, 0.40, 0.35, 0.30, 0.28, 0.25, 0.22, 0.20]


@query("coverage", V("obs", "offers") + """
SELECT (SELECT count(DISTINCT product_id) FROM offers) AS products_seen,
       round((SELECT count(*) FROM part) * (1 - exp(""" + " + ".join(
           f"ln(1 - {r})" for r in CARRY_RATES) + """)), 3) AS expected,
       (SELECT count(*) FROM part) AS universe""")
def q_coverage(spark, sf_dir):
    """Distinct products with an offer beside the carry-rate expectation
    N·(1 − Π(1 − rate)), N = the product universe."""
    seen = fx.offers(spark, sf_dir).agg(F.count_distinct("product_id").alias("products_seen"))
    uni = read_table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("universe"))
    log_keep = sum_ln = None
    for r in CARRY_RATES:
        term = F.log(F.lit(1 - r))
        sum_ln = term if sum_ln is None else sum_ln + term
    del log_keep
    return (seen.crossJoin(uni)   # two one-row aggregates
                .select("products_seen",
                        F.round(F.col("universe") * (1 - F.exp(sum_ln)), 3).alias("expected"),
                        "universe"))


@query("retailer_registry", V("retailers") + """,
incoming AS (SELECT lower(replace(s_name, '#', '-')) AS slug, upper(s_name) AS name FROM supplier),
merged AS (
  SELECT coalesce(i.slug, r.slug) AS slug, coalesce(i.name, r.name) AS name, r.id
  FROM retailers r FULL OUTER JOIN incoming i ON i.slug = r.slug)
SELECT slug, name, coalesce(id, (SELECT max(id) FROM retailers)
                         + row_number() OVER (PARTITION BY id IS NULL ORDER BY slug)) AS id
FROM merged""")
def q_retailer_registry(spark, sf_dir):
    """A10: upsert of every supplier (as an incoming retailer list) into the registry by slug:
    names update, existing ids stay, new slugs get the next ids in slug order."""
    from pricelake.functions.ids import dense_index
    r = fx.retailers(spark, sf_dir)
    incoming = read_table(spark, sf_dir, "supplier").select(
        F.lower(F.regexp_replace("s_name", "#", "-")).alias("slug"),
        F.upper("s_name").alias("new_name"))
    m = (r.join(incoming, "slug", "full")
          .select("slug", F.coalesce("new_name", "name").alias("name"), "id"))
    max_id = r.agg(F.max("id")).first()[0] or 0
    fresh = dense_index(m.filter(F.col("id").isNull()).drop("id"), ["slug"], max_id, "id")
    return (m.filter(F.col("id").isNotNull()).select("slug", "name", F.col("id").cast("long"))
             .unionByName(fresh.select("slug", "name", "id")))


@query("feed_positions", """WITH src AS (
  SELECT CAST(l_suppkey % 8 AS INTEGER) AS retailer_id,
         CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS page FROM lineitem),
pages AS (SELECT retailer_id, page, count(*) AS items FROM src GROUP BY ALL)
SELECT retailer_id, max(page) AS last_page, arg_max(items, page) AS last_items, count(*) AS pages
FROM pages GROUP BY retailer_id""")
def q_feed_positions(spark, sf_dir):
    """Latest processed position per retailer over the page log of the synthetic feed."""
    items = feed.synthetic_items(spark, sf_dir)
    pages = items.groupBy("retailer_id", "page").agg(F.count(F.lit(1)).alias("items"))
    return pages.groupBy("retailer_id").agg(
        F.max("page").alias("last_page"), F.max_by("items", "page").alias("last_items"),
        F.count(F.lit(1)).alias("pages"))


# --- two-phase sync over the page log -----------------------------------------------------------

SYNC_SQL = """WITH RECURSIVE o AS (
  SELECT 'r' || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') AS retailer, CAST(o_orderkey AS BIGINT) AS arrival,
         CAST(round_even(o_totalprice * 100, 0) AS BIGINT) % 61 AS z FROM orders
), n AS (
  SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY arrival) AS seq FROM o
), p AS (
  SELECT *, (seq - 1) % 29 AS j, (seq - 1) // 29 AS c, (seq - 1) % 29 <= 7 AND z <> 11 AS cat FROM n
), q AS (
  SELECT *, j - CASE WHEN z = 5 AND j > 0 THEN 1 ELSE 0 END + CASE WHEN z = 7 THEN 1 ELSE 0 END AS page,
         c // 2 + 1 + CASE WHEN z = 3 THEN 1 ELSE 0 END AS epoch, 100 * c + arrival % 50 AS as_of,
         100 * c + 5 * j - CASE WHEN z = 13 THEN 40 ELSE 0 END AS nxt, z = 2 AS nothing FROM p
), walk(retailer, seq, arrival, verdict, ph, ep, sq, cu, re) AS (
  SELECT retailer, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', 'catalog', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT)
  FROM (SELECT DISTINCT retailer FROM q)
  UNION ALL
  SELECT retailer, seq, arrival, v,
    CASE v WHEN 'start' THEN CASE WHEN page >= 7 THEN 'offers' ELSE 'catalog' END WHEN 'catalog' THEN CASE WHEN page >= 7 THEN 'offers' ELSE 'catalog' END
           WHEN 'gone' THEN 'catalog' ELSE ph END,
    CASE v WHEN 'start' THEN epoch WHEN 'gone' THEN NULL ELSE ep END,
    CASE v WHEN 'start' THEN as_of WHEN 'gone' THEN NULL WHEN 'offers' THEN nxt ELSE sq END,
    CASE v WHEN 'start' THEN CASE WHEN page >= 7 THEN 0 ELSE 1 END WHEN 'catalog' THEN CASE WHEN page >= 7 THEN 0 ELSE page + 1 END WHEN 'gone' THEN 0 ELSE cu END,
    re + CASE WHEN v = 'start' THEN 1 ELSE 0 END
  FROM (
    SELECT q.*, w.ph, w.ep, w.sq, w.cu, w.re,
      CASE WHEN q.cat AND q.page = 0 THEN 'start'
           WHEN q.cat AND w.ph = 'catalog' AND w.cu > 0 AND q.epoch <> w.ep THEN 'gone'
           WHEN q.cat AND w.ph = 'catalog' AND w.cu > 0 AND q.page = w.cu THEN 'catalog'
           WHEN q.cat THEN 'out_of_order'
           WHEN w.ph = 'catalog' THEN 'early'
           WHEN q.epoch <> w.ep THEN 'gone'
           WHEN q.nothing THEN 'idle'
           WHEN q.nxt <= w.sq THEN 'replayed'
           ELSE 'offers' END AS v
    FROM walk w JOIN q ON q.retailer = w.retailer AND q.seq = w.seq + 1)
)
"""


def sync_decisions(spark, sf_dir):
    from pricelake.operators import sync
    from pricelake.sources.feed import synthetic_page_log
    return sync.decide(synthetic_page_log(spark, sf_dir))


@query("sync_pages", SYNC_SQL + "SELECT retailer, arrival, verdict, ph AS s_phase, ep AS s_epoch, sq AS s_seq, cu AS s_cursor, re AS s_resyncs FROM walk WHERE seq > 0")
def q_sync_pages(spark, sf_dir):
    """L2, L3: the verdict of the two-phase sync on every page of the log."""
    return sync_decisions(spark, sf_dir)


@query("sync_positions", SYNC_SQL + """SELECT w.retailer, w.ph AS phase, w.ep AS epoch, w.sq AS seq, w.cu AS cursor, w.re AS resyncs, c.* EXCLUDE (retailer, last)
FROM walk w JOIN (SELECT retailer, max(seq) AS last,
    """ + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS n_{v}" for v in ("start", "catalog", "offers", "idle", "replayed", "early", "out_of_order", "gone")) + """
  FROM walk WHERE seq > 0 GROUP BY retailer) c ON c.retailer = w.retailer AND c.last = w.seq""")
def q_sync_positions(spark, sf_dir):
    """A8 and L13's resyncs: the position of every retailer and its pages by verdict."""
    from pricelake.operators import sync
    return sync.positions(sync_decisions(spark, sf_dir))
