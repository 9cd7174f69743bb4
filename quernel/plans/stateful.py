"""Stateful operators over events, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful as T
from .registry import query, table

RATE = """o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT event_id, user_id, t, i, t AS start, 1 AS n, true AS admitted FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.t, o.i, CASE WHEN o.t - w.start >= 86400000000 THEN o.t ELSE w.start END, CASE WHEN o.t - w.start >= 86400000000 THEN 1 WHEN w.n < 2 THEN w.n + 1 ELSE w.n END, o.t - w.start >= 86400000000 OR w.n < 2
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)"""


@query(f"WITH RECURSIVE {RATE} SELECT event_id AS request_id, admitted, CASE WHEN admitted THEN 0 ELSE greatest(0, 86400000000 - (t - start)) / 1e6 END AS retry_after FROM w")
def t_01_rate_limit(spark, d):
    return T.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 86400)


@query(f"WITH RECURSIVE {RATE} SELECT user_id, count(*) FILTER (NOT admitted) AS rejected, max(CASE WHEN admitted THEN 0 ELSE greatest(0, 86400000000 - (t - start)) / 1e6 END) AS longest_wait FROM w GROUP BY 1")
def t_02_retry_after(spark, d):
    rows = T.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 86400)
    own = table(spark, d, "events").select(F.col("event_id").alias("request_id"), "user_id")
    return rows.join(own, "request_id").groupBy("user_id").agg(F.count_if(~F.col("admitted")).alias("rejected"), F.max("retry_after").alias("longest_wait"))


COST = "CASE event_type WHEN 'purchase' THEN 0.10 WHEN 'error' THEN 0.05 ELSE 0.02 END"


@query(f"SELECT event_id, CAST(coalesce(sum({COST}) OVER w, 0) AS DOUBLE) AS before, round(coalesce(sum({COST}) OVER w, 0), 6) >= 3.0 AS over_cap, round(coalesce(sum({COST}) OVER w, 0), 6) >= 2.4 AS over_admin FROM events WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def t_03_budget(spark, d):
    rows = T.daily_budget(table(spark, d, "events"), "ts", "event_id", F.expr(COST).cast("decimal(10,2)"))
    return rows.select("event_id", F.col("before").cast("double").alias("before"), "over_cap", "over_admin")


@query(
    f"""WITH RECURSIVE o AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST({COST} AS DOUBLE) AS cost, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS i FROM events),
    w AS (SELECT event_id, day, i, cost AS spent, true AS admitted FROM o WHERE i = 1
      UNION ALL SELECT o.event_id, o.day, o.i, w.spent + CASE WHEN w.spent < 3.0 THEN o.cost ELSE 0 END, w.spent < 3.0 FROM w JOIN o ON o.day = w.day AND o.i = w.i + 1)
    SELECT event_id AS request_id, admitted FROM w"""
)
def t_03_admitted_budget(spark, d):
    return T.admitted_budget(table(spark, d, "events"), "ts", "event_id", "event_id", F.expr(COST))


SESSION = "g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)"


@query(f"WITH {SESSION} SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session")
def t_04_sessions(spark, d):
    return T.sessions(table(spark, d, "events"), "user_id", "ts")


@query("SELECT conv_id, turn, role, from_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations) WHERE from_end <= 3")
def w_03_last_turns(spark, d):
    return T.last_turns(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", "from_end")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 ORDER BY event_id DESC LIMIT 200")
def w_04_last_write(spark, d):
    return T.last_write(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down, (SELECT count(*) FROM events) AS total_raw FROM l")
def a_23_feedback_counts(spark, d):
    rows = table(spark, d, "events")
    last = rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))
    return last.agg(F.count_if(F.col("event_type") == "purchase").alias("up"), F.count_if(F.col("event_type") == "error").alias("down")).crossJoin(rows.agg(F.count("*").alias("total_raw")))


@query("SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS slot, sum(value) AS delta FROM events GROUP BY 1, 2")
def t_05_debounced(spark, d):
    return T.debounced(table(spark, d, "events"), "user_id", "ts", "value")


@query("SELECT user_id, event_type, count(*) AS touched, min(ts) AS created, max(ts) AS updated FROM events GROUP BY 1, 2")
def t_06_filing_upsert(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("touched"), F.min("ts").alias("created"), F.max("ts").alias("updated"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events CROSS JOIN m WHERE ts >= now - INTERVAL 1 DAY OR event_type = 'error'")
def t_07_ttl_eviction(spark, d):
    rows = table(spark, d, "events")
    now = rows.agg(F.max("ts").alias("now"))
    return rows.crossJoin(F.broadcast(now)).where("ts >= now - INTERVAL 1 DAY OR event_type = 'error'").select("event_id")


@query("WITH e AS (SELECT l_suppkey, l_shipdate AS t, 1 AS d FROM lineitem UNION ALL SELECT l_suppkey, l_shipdate + INTERVAL 3 DAY, -1 FROM lineitem), o AS (SELECT l_suppkey, sum(d) OVER (PARTITION BY l_suppkey ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM e) SELECT l_suppkey, max(open) AS peak FROM o GROUP BY 1")
def t_10_peak_overlap(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("e"))
    return T.peak_overlap(rows, "s", "e", ["l_suppkey"])


@query("SELECT event_id, event_type IN ('view', 'click') AND sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 100 AS degraded FROM events")
def t_11_degraded_routing(spark, d):
    from pyspark.sql import Window

    spent = F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, d, "events").select("event_id", (F.col("event_type").isin("view", "click") & (spent > 100)).alias("degraded"))


@query("SELECT user_id, count(DISTINCT event_type) AS sources, count(*) AS done FROM events GROUP BY 1")
def t_12_progress(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("sources"), F.count("*").alias("done"))


@query("SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN text ELSE coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' / ' || text END AS rewritten FROM conversations")
def t_13_rewrite(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id")
    first = F.col("turn") == F.min("turn").over(by)
    before = F.coalesce(F.lag("text").over(by.orderBy("turn")), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(first, F.col("text")).otherwise(F.concat(before, F.lit(" / "), F.col("text"))).alias("rewritten"))


@query("WITH r AS (SELECT o_orderkey, o_orderstatus, coalesce(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) SELECT o_orderkey, o_orderstatus FROM r WHERE b <= 1000000")
def t_15_spend_cutoff(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return T.spend_cutoff(rows, "o_orderkey", "o_totalprice", 1_000_000.0, ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, phase, sum(tokens) AS tokens FROM (SELECT l_orderkey, unnest(['in', 'out']) AS phase, unnest([l_quantity, l_extendedprice]) AS tokens FROM lineitem) GROUP BY 1, 2")
def t_14_replay_ledger(spark, d):
    calls = F.array(F.struct(F.lit("in").alias("phase"), F.col("l_quantity").alias("tokens")), F.struct(F.lit("out").alias("phase"), F.col("l_extendedprice").alias("tokens")))
    return table(spark, d, "lineitem").select("l_orderkey", F.explode(calls).alias("c")).groupBy("l_orderkey", "c.phase").agg(F.sum("c.tokens").alias("tokens"))


@query(r"WITH t AS (SELECT item_id AS id, regexp_extract_all(text, '\s*\S+\s*') AS w FROM benchmark), f AS (SELECT id, unnest(range(len(w) + 2)) AS seq, w FROM t) SELECT id, CAST(seq AS INT) AS seq, CASE WHEN seq = 0 THEN 'sources' WHEN seq > len(w) THEN 'done' ELSE 'token' END AS event, CASE WHEN seq = 0 THEN '{\"id\":\"' || id || '\"}' WHEN seq > len(w) THEN '{}' ELSE w[seq] END AS data FROM f".replace('\\"', '"'))
def k_11_sse_frames(spark, d):
    return T.sse_frames(table(spark, d, "benchmark"), "item_id", "text")
