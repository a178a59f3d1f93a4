"""Streams of fetch and visit events: health windows, sessions, first sight, price alerts.

Each transformation takes a DataFrame with ``ts`` and works on a stream or on
a table, so batch results check the streaming ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlight.sources.written import shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "1 hour"


def stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def error_rate(events: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests and errors by tumbling or sliding window."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", LATE).groupBy(w.alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("start"), "events", "errors")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Visits of a user: events at most ``gap`` apart."""
    s = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").alias("start"), "events")


def first_seen(events: DataFrame) -> DataFrame:
    """One row per user and type within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def price_alerts(events: DataFrame) -> DataFrame:
    """key, low, high: a row whenever a key's second and later distinct whole prices arrive."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        low, high = state.get if state.exists else (None, None)
        alerts = []
        for frame in frames:
            for price in frame.sort_values("event_id")["price"]:
                changed = low is not None and not low <= price <= high
                low = price if low is None else min(low, price)
                high = price if high is None else max(high, price)
                if changed:
                    alerts.append((key[0], low, high))
        state.update((low, high))
        yield pd.DataFrame(alerts, columns=["key", "low", "high"])

    prices = events.where("event_type = 'purchase'").select(F.pmod("user_id", F.lit(20)).alias("key"), F.floor("value").cast("long").alias("price"), "event_id")
    return prices.groupBy("key").applyInPandasWithState(update, "key long, low long, high long", "low long, high long", "append", "NoTimeout")


#: Arrivals without news after which a key is forgotten.
FORGOTTEN = 3000


#: Rows that a part of the arrivals has, about; a number behind all arrivals, at which every key is forgotten.
PART, END = 1_000_000, 10**9


def arrivals(spark: SparkSession, events: DataFrame, parts: int | None = None) -> str:
    """The events as a folder that a stream reads in order of event_id: a file for each stretch of numbers.

    There are at least 6 stretches and no more than about PART numbers in one, so a batch does not grow with the events.
    They are dealt in one pass; the files are then written one after the other, as a stream reads them by age.  The last
    has a row without user and type, END behind all others, with which the watermark passes whatever has arrived.
    """
    shared = shared_folder(spark)
    folder, dealt = f"{shared}/arrivals-{uuid.uuid4().hex}", f"{shared}/dealt-{uuid.uuid4().hex}"
    last = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    parts = parts or max(6, -(-last // PART))
    plain = events.select(*(c.split()[0] for c in SCHEMA.split(", "))).where("event_id >= 0")
    stretch = F.floor(F.col("event_id") * parts / last).cast("int")
    plain.withColumn("part", F.least(stretch, F.lit(parts - 1))).repartition("part").write.partitionBy("part").parquet(dealt)
    read = spark.read.schema(f"{SCHEMA}, part int").parquet(dealt)
    for k in range(parts):
        some = read.where(F.col("part") == k).drop("part")
        if k == parts - 1:
            some = some.unionByName(spark.range(last + END, last + END + 1).select(F.col("id").alias("event_id")), allowMissingColumns=True)
        some.coalesce(1).write.mode("append").parquet(folder)
    return folder


def to_the_end(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a streaming DataFrame gives when its source is read to the end, as a table in the shared folder."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _numbered(events: DataFrame) -> DataFrame:
    """Arrival as time, a second a row from 1 on: the watermark follows what has arrived, so rows of late ``ts`` are not lost."""
    return events.withColumn("arrival", F.timestamp_seconds(F.col("event_id") + 1)).withWatermark("arrival", "0 seconds")


def _keep(state, value: tuple, last: int, forgotten: int) -> None:
    """State and the timer that drops it; rows of one batch may be behind the watermark already."""
    state.update((*value, last))
    state.setTimeoutTimestamp(max(1000 * (last + 1 + forgotten), state.getCurrentWatermarkMs() + 1))


def widening_prices(events: DataFrame, forgotten: int = FORGOTTEN) -> DataFrame:
    """key, event_id, low, high: an alert whenever a price falls outside of what its key had so far.

    A key without a purchase for more than ``forgotten`` arrivals begins anew; its state is dropped by a timer.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        low, high, last = state.get if state.exists else (None, None, None)
        rows = sorted((int(i), int(p)) for frame in frames for i, p in zip(frame["event_id"], frame["price"], strict=True))
        alerts = []
        for event_id, price in rows:
            if last is not None and event_id - last > forgotten:
                low = high = None
            news = low is not None and not low <= price <= high
            low, high, last = price if low is None else min(low, price), price if high is None else max(high, price), event_id
            if news:
                alerts.append((key[0], event_id, low, high))
        _keep(state, (low, high), last, forgotten)
        yield pd.DataFrame(alerts, columns=["key", "event_id", "low", "high"])

    prices = _numbered(events).where("event_type = 'purchase' and value is not null").select(F.pmod("user_id", F.lit(20)).alias("key"), F.floor("value").cast("long").alias("price"), "event_id", "arrival")
    return prices.groupBy("key").applyInPandasWithState(update, "key long, event_id long, low long, high long", "low long, high long, last long", "append", "EventTimeTimeout")


def first_sights(events: DataFrame, forgotten: int = FORGOTTEN) -> DataFrame:
    """user_id, event_type, event_id of rows whose user and type have not been seen for ``forgotten`` arrivals.

    They begin the sessions of user and type by arrival; the gap ends between two arrivals, so none falls on it.
    """
    gap = F.session_window("arrival", f"{forgotten} seconds 500 milliseconds")
    return _numbered(events).groupBy("user_id", "event_type", gap).agg(F.min("event_id").alias("event_id")).select("user_id", "event_type", "event_id")


def upsert(rows: DataFrame, batch: int, path: str, key: list[str]) -> None:
    """For foreachBatch: a snapshot per batch in which the latest row of a key stands; earlier snapshots are not touched."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    now = rows.withColumn("_batch", F.lit(batch))
    if batch:
        now = now.unionByName(spark.read.parquet(f"{path}/batch={batch - 1}"))
    w = Window.partitionBy(*key).orderBy(F.desc("_batch"))
    now.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def late_events(events: DataFrame, parts: int, delay: str) -> DataFrame:
    """The events of a batch with ``late``: whether a stream that reads ``parts`` parts in order of event_id would drop them.

    Parts are few, whatever the events, so the marks are one small table.
    """
    count = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    numbered = events.withColumn("part", F.floor(F.col("event_id") * parts / count))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    latest = numbered.groupBy("part").agg(F.max("ts").alias("latest"))
    marks = latest.select("part", (F.max("latest").over(before) - F.expr(f"interval {delay}")).alias("mark"))
    return numbered.join(F.broadcast(marks), "part").withColumn("late", F.coalesce(F.col("ts") < F.col("mark"), F.lit(False))).drop("part", "mark")
