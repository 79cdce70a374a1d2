"""Queries of the streams (ST), run over all available events into a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import streams as st
from .registry import Tables, query


def events(t: Tables) -> DataFrame:
    return st.read_events(t.spark, f"{t.sf_dir}/events.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Instants as wall-clock times in UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


#: Events arrive up to four days after they happen, in files by the week of arrival.
ARRIVALS = 5
_ARRIVED = "CAST(greatest(0, least({n} - 1, floor((epoch(ts) + event_id * 7919 % 97 * 3600 - (SELECT min(epoch(ts)) FROM events)) / 604800))) AS INT)".format(n=ARRIVALS)


def arrivals(t: Tables) -> DataFrame:
    """Events as a stream of micro-batches, a file of arrivals each; some are late."""
    e = t["events"]
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    first = e.agg(F.min(seconds(F.col("ts"))).alias("first"))
    lag = F.col("event_id") * 7919 % 97 * 3600
    at = F.greatest(F.lit(0), F.least(F.lit(ARRIVALS - 1), F.floor((seconds(F.col("ts")) + lag - F.col("first")) / 604800))).cast("int")
    path = f"{st.scratch(t.spark)}/arrivals"
    st.write_arrivals(e.crossJoin(F.broadcast(first)).withColumn("part", at).drop("first"), "part", ARRIVALS, path)
    return st.read_events(t.spark, path, files=1)


@query("st1_freshness", f"WITH b AS (SELECT *, {_ARRIVED} AS part FROM events), m AS (SELECT part, max(ts) AS latest FROM b GROUP BY ALL), w AS (SELECT part, max(latest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) SELECT event_id, CASE WHEN ts < seen - INTERVAL 72 HOUR THEN 'EXPIRED_NEWS' END AS reason FROM b JOIN w USING (part)")
def st1(t: Tables) -> DataFrame:
    path = st.with_freshness(arrivals(t), 72)
    fresh, late = (t.spark.read.parquet(f"{path}/{x}") for x in ("fresh", "excluded"))
    return late.select("event_id", "reason").unionByName(fresh.select("event_id", F.lit(None).cast("string").alias("reason")))


@query("st2_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def st2(t: Tables) -> DataFrame:
    return st.run_available(st.dedup(events(t), ["user_id", "event_type"], "72 hours")).select("user_id", "event_type")


@query("st2b_first_wins")
def st2b(t: Tables) -> DataFrame:
    """Greedy over two keys in the order of arrival, with state across micro-batches."""
    stream = arrivals(t).withColumns({"props_key": F.concat_ws("|", "user_id", "props"), "value_key": F.concat_ws("|", "event_type", "value")})
    path = st.dedup_first_wins(stream, ["props_key", "value_key"], ["ts", "event_id"], "event_id", 24 * 365)
    return t.spark.read.parquet(f"{path}/accepted").select("event_id")


@query("st3_weekly_bars", "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL HAVING count(*) >= 2")
def st3(t: Tables) -> DataFrame:
    return plain(st.run_available(st.bars(events(t), ["event_type"], "value", "1 hour", 2)).withColumn("mean_value", F.round("mean_value", 6)))


@query("st4_sliding", "WITH w AS (SELECT e.*, (date_trunc('day', ts) - (epoch(date_trunc('day', ts))::BIGINT // 86400 % 7) * INTERVAL 1 DAY) - k * INTERVAL 7 DAY AS from_ts FROM events e, range(3) r(k)) SELECT CAST(from_ts AS TIMESTAMP) AS from_ts, CAST(from_ts + INTERVAL 21 DAY AS TIMESTAMP) AS to_ts, event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM w WHERE from_ts + INTERVAL 21 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def st4(t: Tables) -> DataFrame:
    return plain(st.run_available(st.sliding(events(t), ["event_type"], "value", "21 days", "7 days", "1 hour")).withColumn("mean_value", F.round("mean_value", 6)))


@query("st5_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT min(ts) AS from_ts, max(ts) + INTERVAL 6 HOUR AS to_ts, user_id, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def st5(t: Tables) -> DataFrame:
    return plain(st.run_available(st.sessions(events(t), ["user_id"], "6 hours", "1 hour")))


@query("st6_enrich", "SELECT e.event_id, max(p.event_date) AS known_date FROM events e JOIN v_signals p ON p.user_id = e.user_id AND p.event_date < CAST(e.ts AS DATE) AND p.event_date >= CAST(e.ts AS DATE) - 7 WHERE e.event_type = 'purchase' GROUP BY ALL")
def st6(t: Tables) -> DataFrame:
    from ..operators.asof import asof_join

    facts = t.signals.select("user_id", "event_date", F.col("event_date").alias("known_date"))

    def each(df: DataFrame) -> DataFrame:
        left = df.where("event_type = 'purchase'").select("event_id", "user_id", F.date_sub(F.to_date("ts"), 1).alias("before"))
        return asof_join(left, facts, ["user_id"], "before", "event_date", ["known_date"], 6).where("known_date is not null").select("event_id", "known_date")

    return t.spark.read.parquet(f"{st.enrich(events(t), each)}/out").select("event_id", "known_date")


@query("st7_outcomes", "SELECT f.event_id AS forecast_id, r.event_id AS outcome_id, f.user_id, f.ts AS made, r.ts AS seen FROM events f JOIN events r ON f.user_id = r.user_id AND r.ts >= f.ts + INTERVAL 7 DAY AND r.ts <= f.ts + INTERVAL 7 DAY + INTERVAL 1 DAY WHERE f.event_type = 'signup' AND r.event_type = 'purchase'")
def st7(t: Tables) -> DataFrame:
    e = events(t)
    return plain(st.run_available(st.outcomes(e.where("event_type = 'signup'"), events(t).where("event_type = 'purchase'"), "user_id", "7 DAYS", "1 DAY", "10 days")))


@query("st8_freshness_machine")
def st8(t: Tables) -> DataFrame:
    """Views in the order of their time, in micro-batches. A record carries the hash of its content, which for some events does not fit it."""
    path = f"{st.scratch(t.spark)}/views"
    views = t["events"].where("event_type = 'view'").withColumn("part", F.floor((F.dayofmonth("ts") - 1) / 8).cast("int"))
    st.write_arrivals(views, "part", 4, path)
    record = F.concat_ws("|", "event_id", "props")
    claimed = F.sha2(F.when(F.col("event_id") % 11 == 0, F.concat(record, F.lit("!"))).otherwise(record), 256)
    return plain(st.run_available(st.freshness_machine(st.read_events(t.spark, path, 1), "user_id", "value", 24, "1 hour", F.sha2(record, 256) == claimed)))


@query("st9_daily_admit", "SELECT DISTINCT CAST(timezone('Asia/Shanghai', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) AS local_date FROM events WHERE CAST(timezone('Asia/Shanghai', timezone('UTC', CAST(ts AS TIMESTAMP))) AS DATE) NOT IN (SELECT event_date FROM v_signals WHERE event_date < DATE '2024-01-10')")
def st9(t: Tables) -> DataFrame:
    history = t.signals.where("event_date < date'2024-01-10'").select(F.col("event_date").alias("local_date"))
    return st.run_available(st.daily_admit(events(t), history, "Asia/Shanghai", "72 hours"))


@query("st10_metrics", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS repeated, min(a) AS first_ts, max(b) AS last_ts FROM (SELECT user_id, event_type, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)")
def st10(t: Tables) -> DataFrame:
    path = st.metrics(events(t), ["user_id", "event_type"])
    got = t.spark.read.parquet(f"{path}/out").agg(F.sum("rows").alias("rows"), F.sum("repeated").alias("repeated"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return plain(got)


@query("st10b_observed", f"WITH b AS (SELECT *, {_ARRIVED} AS part FROM events), n AS (SELECT part, count(*) AS rows, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value > 20) AS large, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY ALL) SELECT part AS batch, rows, negative, large, first_ts, last_ts, (SELECT count(*) FROM events) AS written FROM n")
def st10b(t: Tables) -> DataFrame:
    """Counts of every micro-batch from the scan that writes it, beside the rows that were written."""
    value = F.col("value")
    counts = {"rows": F.count(F.lit(1)), "negative": F.count_if(value < 0), "large": F.count_if(value > 20), "first_ts": F.min("ts"), "last_ts": F.max("ts")}
    out, seen = st.run_observed(arrivals(t), counts)
    rows = [(batch, *[m[k] for k in counts]) for batch, m in sorted(seen.items()) if m["rows"]]
    got = t.spark.createDataFrame(rows, "batch int, rows bigint, negative bigint, large bigint, first_ts timestamp, last_ts timestamp")
    return plain(got.crossJoin(F.broadcast(out.agg(F.count(F.lit(1)).alias("written")))))
