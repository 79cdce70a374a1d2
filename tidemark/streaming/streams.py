"""Event-time operators on Structured Streaming.

Each takes a streaming DataFrame with a `timestamp` column `ts` and returns one;
`run_available` processes all that is there and returns what was written.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..session import cut, shared_dir


def read_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Parquet events as a stream, of so many files a batch (all, if not given); `ts` becomes a timestamp with zone, as watermarks need it."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # as a glob the path may name a single file, too
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def write_arrivals(df: DataFrame, part: str, parts: int, path: str) -> None:
    """df as files that arrive one after the other, by the number in `part`; a stream reads them in that order. All tasks scan, one writes a file."""
    for i in range(parts):
        df.where(F.col(part) == i).drop(part).repartition(1).write.mode("append").parquet(path)


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run the stream over all available data into a Parquet sink in the shared folder, and read it. With a path of an earlier run it goes on from its checkpoint."""
    spark, path = stream.sparkSession, path or scratch(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True)
    with keyed_state(spark):
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


class Observed(StreamingQueryListener):
    """The observed metrics of every batch of the queries of a session, by query and batch."""

    def __init__(self) -> None:
        self.metrics: dict[tuple[str, int], dict] = {}
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        with self.news:
            for row in event.progress.observedMetrics.values():
                self.metrics[(str(event.progress.id), event.progress.batchId)] = row.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self.news:
            self.ended.add(str(event.id))
            self.news.notify_all()


def run_observed(stream: DataFrame, metrics: dict[str, Column], path: str | None = None) -> tuple[DataFrame, dict[int, dict]]:
    """As `run_available`, with `metrics` (aggregates) of every batch by its number, taken by the scan that writes the batch: no job of their own."""
    spark, path = stream.sparkSession, path or scratch(stream.sparkSession)
    seen = Observed()
    spark.streams.addListener(seen)
    try:
        watched = stream.observe("metrics", *[c.alias(k) for k, c in metrics.items()])
        with keyed_state(spark):
            query = watched.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
            query.awaitTermination()
        with seen.news:  # events come after the query has ended
            seen.news.wait_for(lambda: str(query.id) in seen.ended, timeout=60)
    finally:
        spark.streams.removeListener(seen)
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), {batch: m for (own, batch), m in seen.metrics.items() if own == str(query.id)}


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int, str], None], path: str | None = None) -> str:
    """Run `each` on every micro-batch; returns the folder it may write to, which also holds the checkpoint. A batch that is repeated must overwrite its own part."""
    path = path or scratch(stream.sparkSession)
    stream.writeStream.foreachBatch(lambda df, i: each(df, i, path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return path


#: Batches after which the keys that are still alive are gathered in one part, so that a batch reads no more parts than this and one.
BATCHES_PER_SNAPSHOT = 20


def _parts(path: str, names: list[str], spark: SparkSession, schema: str) -> DataFrame:
    """What earlier batches have written to path/name, for each of names."""
    return spark.read.schema(schema).parquet(*[f"{path}/{x}" for x in names]) if names else spark.createDataFrame([], schema)


def with_freshness(stream: DataFrame, hours: int, path: str | None = None) -> str:
    """Rows go to fresh/, or to excluded/ with EXPIRED_NEWS if they are late: more than `hours` behind the latest time of all batches before theirs.

    That watermark is kept beside the sinks, a row a batch that holds all
    batches so far, written before the batch's rows. A batch that is repeated after a failure finds the same one
    and overwrites its own part, so no row is in both sinks or in one twice.
    Rows of the first batch are never late. A row without a time is late.
    Running it again on the same path goes on where it was.
    """

    def each(df: DataFrame, i: int, at: str) -> None:
        spark = df.sparkSession
        before = _parts(at, [f"watermark/batch={i - 1}"] if i else [], spark, "latest timestamp")
        seen = before.agg(F.max("latest")).first()[0]
        df.select(F.col("ts").alias("latest")).unionByName(before).agg(F.max("latest").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{at}/watermark/batch={i}")
        late = F.col("ts").isNull() if seen is None else F.coalesce(F.col("ts") < F.lit(seen) - F.make_dt_interval(hours=F.lit(hours)), F.lit(True))
        marked = df.withColumn("reason", F.when(late, "EXPIRED_NEWS")).persist()
        marked.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{at}/fresh/batch={i}")
        marked.where("reason is not null").write.mode("overwrite").parquet(f"{at}/excluded/batch={i}")
        marked.unpersist()

    return run_batches(stream, each, path)


def dedup_first_wins(stream: DataFrame, keys: list[str], order: list[str], id_col: str, hours: int, path: str | None = None) -> str:
    """Rows that share none of several keys with an earlier accepted row go to accepted/, others to excluded/.

    Rows of one id in a batch count once, as the first of them. A row that is excluded does not take its keys; in a batch rows come by
    `order`. The state is the keys of accepted rows with their time, a part
    for each batch; those that are `hours` behind the latest time of the
    batches before are forgotten, which bounds it, and every
    BATCHES_PER_SNAPSHOT batches the rest is gathered. Null keys match nothing. A
    batch that is repeated overwrites its own parts.
    """
    from ..operators.evidence import dedup_multi

    def each(df: DataFrame, i: int, at: str) -> None:
        spark = df.sparkSession
        df = df.persist()
        kind, turn = "key string, ts timestamp", i // BATCHES_PER_SNAPSHOT * BATCHES_PER_SNAPSHOT
        alive = lambda old: old if (latest := old.agg(F.max("ts")).first()[0]) is None else old.where(F.col("ts") >= F.lit(latest) - F.make_dt_interval(hours=F.lit(hours)))
        since = lambda start, end: [f"snapshot/batch={start}"] * (start > 0) + [f"keys/batch={k}" for k in range(start, end)]
        if i and i == turn:
            alive(_parts(at, since(i - BATCHES_PER_SNAPSHOT, i), spark, kind)).write.mode("overwrite").parquet(f"{at}/snapshot/batch={i}")
        live = alive(_parts(at, since(turn, i), spark, kind))
        by_key = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(k).cast("string"))) for n, k in enumerate(keys)]))
        pairs = df.select(id_col, F.explode(by_key).alias("key"))
        known = cut(pairs.join(live.select("key").distinct(), "key", "left_semi").select(id_col).distinct())
        ids = cut(dedup_multi(df.join(known, id_col, "left_anti"), keys, order, id_col).select(F.col("id").alias("_id")))
        won = F.col(id_col).eqNullSafe(F.col("_id"))
        accepted = df.groupBy(id_col).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*").join(ids, won, "left_semi")
        accepted.write.mode("overwrite").parquet(f"{at}/accepted/batch={i}")
        df.join(ids, won, "left_anti").write.mode("overwrite").parquet(f"{at}/excluded/batch={i}")
        accepted.select(F.explode(by_key).alias("key"), "ts").write.mode("overwrite").parquet(f"{at}/keys/batch={i}")
        df.unpersist()

    return run_batches(stream, each, path)


def dedup(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First row of each key within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def bars(stream: DataFrame, keys: list[str], value: str, delay: str, min_n: int = 1) -> DataFrame:
    """Weekly bars that begin on Mondays; a bar is emitted once the watermark has passed it."""
    week = F.window("ts", "7 days", startTime="4 days")
    got = stream.withWatermark("ts", delay).groupBy(week, *keys).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return got.where(F.col("n") >= min_n).select(F.col("window.start").alias("week"), *keys, "mean_value", "n")


def sliding(stream: DataFrame, keys: list[str], value: str, width: str, step: str, delay: str) -> DataFrame:
    got = stream.withWatermark("ts", delay).groupBy(F.window("ts", width, step), *keys).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), *keys, "mean_value", "n")


def sessions(stream: DataFrame, keys: list[str], gap: str, delay: str) -> DataFrame:
    got = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("session_window.start").alias("from_ts"), F.col("session_window.end").alias("to_ts"), *keys, "n")


def enrich(stream: DataFrame, each: Callable[[DataFrame], DataFrame]) -> str:
    """A batch operator (such as a bitemporal join to a static table) on every micro-batch, written to out/."""
    return run_batches(stream, lambda df, i, path: each(df).write.mode("overwrite").parquet(f"{path}/out/batch={i}"))


def outcomes(forecasts: DataFrame, results: DataFrame, key: str, due: str, tolerance: str, delay: str) -> DataFrame:
    """Forecasts with results from `due` after them until `tolerance` later; both sides have a watermark, so state is bounded."""
    f = forecasts.select(F.col("event_id").alias("forecast_id"), F.col(key).alias("f_key"), F.col("ts").alias("made")).withWatermark("made", delay)
    r = results.select(F.col("event_id").alias("outcome_id"), F.col(key).alias("r_key"), F.col("ts").alias("seen")).withWatermark("seen", delay)
    on = F.expr(f"f_key = r_key AND seen >= made + INTERVAL {due} AND seen <= made + INTERVAL {due} + INTERVAL {tolerance}")
    return f.join(r, on).select("forecast_id", "outcome_id", F.col("f_key").alias(key), "made", "seen")


FRESHNESS = "key bigint, at bigint, status string, value double"


class FreshnessMachine(StatefulProcessor):
    """The last good value of a key, and a timer at its expiry, and later at the end of its keeping. Times are in microseconds."""

    def __init__(self, hours: int, keep_hours: int, reasons: bool) -> None:
        self.span, self.keep, self.width = hours * 3_600_000_000, keep_hours * 3_600_000_000, 4 + reasons

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.good = handle, handle.getValueState("good", "at bigint, value double, live boolean")

    def _row(self, *values) -> Row:  # noqa: ANN002
        return Row(**dict(zip(("key", "at", "status", "value", "reason")[: self.width], values)))

    def _due(self, at: int, live: bool) -> int:
        """When the timer of a state goes off; a key has that one only."""
        return (at + self.span if live else at + self.span + self.keep) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        old = self.good.get()
        at, held, live = old if old is not None else (None, None, False)
        before = (at, live)
        for t, none, value, verified in sorted((r["at"], r["value"] is None, r["value"], r["verified"]) for r in rows):
            if at is not None and t < at:
                continue  # older than what is known
            if live and at + self.span < t:
                yield self._row(key[0], at + self.span, "STALE", held, "EXPIRED")
                live = False
            if not verified:
                if self.width > 4:
                    yield self._row(key[0], t, "LIVE" if live else "UNAVAILABLE" if at is None else "STALE", held, "HASH_MISMATCH")
                continue
            if not live:
                yield self._row(key[0], t, "LIVE", value, None)
            at, held, live = t, value, True
        if at is not None and (at, live) != before:
            if before[0] is not None:
                self.handle.deleteTimer(self._due(*before))
            self.good.update((at, held, live))
            self.handle.registerTimer(self._due(at, live))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        at, held, live = self.good.get()
        if live:
            self.good.update((at, held, False))
            self.handle.registerTimer(self._due(at, False))
            yield self._row(key[0], at + self.span, "STALE", held, "EXPIRED")
        else:
            self.good.clear()

    def close(self) -> None:
        pass


def freshness_machine(stream: DataFrame, key: str, value: str, hours: int, delay: str, verified: Column | None = None, keep_hours: int = 24 * 365) -> DataFrame:
    """The status of each key as it changes (key, at, status, value), with `verified` also its reason.

    LIVE at a good value; STALE once `hours` have passed without another, with
    the last good value. A value that is null or fails its verification never
    takes the good one's place: it is reported with HASH_MISMATCH under the
    status that stays, which is UNAVAILABLE as long as there is no good value.
    Rows older than the good value are passed over, so results do not depend
    on how batches cut a key's rows as long as these arrive in order.
    `keep_hours` after it has expired a key is forgotten.
    """
    from ..session import ship

    ship(stream.sparkSession)
    good = F.col(value).isNotNull() & (F.lit(True) if verified is None else F.coalesce(verified, F.lit(False)))
    rows = stream.withWatermark("ts", delay).select(F.col(key).cast("bigint").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col(value).cast("double").alias("value"), good.alias("verified")).where("ts is not null")
    got = rows.groupBy("key").transformWithState(
        statefulProcessor=FreshnessMachine(hours, keep_hours, verified is not None), outputStructType=FRESHNESS + ", reason string" * (verified is not None), outputMode="Append", timeMode="EventTime"
    )
    return got.withColumn("at", F.timestamp_micros("at"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Processors with state of their own need the RocksDB store; the session's setting comes back when the stream has run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def daily_admit(stream: DataFrame, history: DataFrame, zone: str, delay: str) -> DataFrame:
    """One row per local day that is not in history yet."""
    local = F.to_date(F.from_utc_timestamp("ts", zone))
    fresh = stream.withWatermark("ts", delay).withColumn("local_date", local).join(F.broadcast(history.select("local_date").distinct()), "local_date", "left_anti")
    return fresh.dropDuplicates(["local_date"]).select("local_date")


def metrics(stream: DataFrame, keys: list[str]) -> str:
    """Rows, repeated keys, first and last time of every micro-batch, written to out/."""

    def each(df: DataFrame, i: int, path: str) -> None:
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).write.mode("overwrite").parquet(f"{path}/out/batch={i}")

    return run_batches(stream, each)
